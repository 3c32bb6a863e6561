"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Per query: one warm-up, then the median of three runs, each from building the query to the last row.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402

# Query and the test table whose rows it works through.
HEADLINE = {
    "stage_task_distribution": "orders",
    "diag_all": "orders",
    "stage_rdd_callsite": "part",
    "alert_throttle": "orders",
    "straggler_host_asof": "events",
    "executor_rollup": "orders",
    "host_counter_rate": "events",
    "host_cpu_usage": "events",
    "executor_poll_failures": "events",
    "top_tasks_per_stage": "orders",
}
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("jobscope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    counts = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").count() for n in ("orders", "events", "part")}
    rates = {n: round(counts[HEADLINE[n]] / t) for n, t in times.items() if n in HEADLINE}
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(found.group(1)) if found else None, "rows_per_sec": rates, "input_rows": counts,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
