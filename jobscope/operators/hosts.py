"""Host metrics: instances behind host names, load, CPU, memory and paging rates.

Samples are rows ``(metric, instance, mode, cpu, ts_ms, value)``; a series is one combination of
the first four, with one sample per time.  Rates read at most LOOKBACK_MS of a series.  Windows are
therefore cut by time, never over the whole history of a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Metric names, CPU modes, ranges of the two rates, bytes per paged unit.
LOADS = {"load1": "node_load1", "load5": "node_load5", "load15": "node_load15"}
CPU = "node_cpu"
CPU_MODES = ["system", "idle", "user"]
AVAILABLE = "node_memory_MemAvailable"
FREE_PARTS = ["node_memory_MemFree", "node_memory_Buffers", "node_memory_Cached"]
PAGE_IN = "node_vmstat_pgpgin"
PAGE_OUT = "node_vmstat_pgpgout"
UNAME = "node_uname_info"
RATE_MS = 5_000
LOOKBACK_MS = 300_000
PAGE_BYTES = 1024

SERIES = ["metric", "instance", "mode", "cpu"]
# Series are cut into hours for the per-sample rates.
SLICE_MS = 3_600_000


def host_names(samples: DataFrame) -> DataFrame:
    """``(nodename, instance)`` from the info samples."""
    return samples.filter(F.col("metric") == UNAME).select("nodename", "instance")


def resolve_hosts(hosts: DataFrame, names: DataFrame) -> DataFrame:
    """Adds the monitoring instance of each host; the first one in order, null where there is none."""
    first = names.groupBy(F.col("nodename").alias("host")).agg(F.min("instance").alias("instance"))
    return hosts.join(first, "host", "left")


def _increase(previous: Column, current: Column) -> Column:
    """Growth of a counter; a drop means it was reset to 0 in between."""
    return F.when(current >= previous, current - previous).otherwise(current)


def counter_rates(samples: DataFrame) -> DataFrame:
    """Each counter sample with its rate per second at that time.

    The rate over the last 5 s if at least two samples lie there, else the rate between the last two
    samples within 5 minutes, else null.  A sample belongs to its hour; the tail of the hour before
    is copied into it, so hours are independent and the result is exact.
    """
    hour = F.floor(F.col("ts_ms") / SLICE_MS)
    copies = F.when(
        F.floor((F.col("ts_ms") + LOOKBACK_MS) / SLICE_MS) > hour, F.array(hour, hour + 1)
    ).otherwise(F.array(hour))
    placed = samples.select(*SERIES, "ts_ms", "value", hour.alias("own"), F.explode(copies).alias("slice"))
    series = Window.partitionBy(*SERIES, "slice").orderBy("ts_ms")
    recent = series.rangeBetween(-(RATE_MS - 1), 0)
    stepped = placed.select(
        "*",
        F.lag("ts_ms").over(series).alias("before_ms"),
        _increase(F.lag("value").over(series), F.col("value")).alias("step"),
    )
    grown = F.sum("step").over(recent) - F.coalesce(F.first("step").over(recent), F.lit(0.0))
    seconds = (F.col("ts_ms") - F.min("ts_ms").over(recent)) / 1000
    over_range = F.when(F.count(F.lit(1)).over(recent) >= 2, F.try_divide(grown, seconds))
    last_two = F.when(
        F.col("ts_ms") - F.col("before_ms") < LOOKBACK_MS,
        F.try_divide(F.col("step"), (F.col("ts_ms") - F.col("before_ms")) / 1000),
    )
    return stepped.select(
        *SERIES, "ts_ms", "own", "slice", F.coalesce(over_range, last_two).alias("rate")
    ).filter(F.col("own") == F.col("slice")).drop("own", "slice")


def at_ticks(samples: DataFrame, step_ms: int = LOOKBACK_MS) -> DataFrame:
    """Samples under every evaluation time ``eval_ms`` (a multiple of ``step_ms``) that looks at them."""
    first = F.ceil(F.col("ts_ms") / step_ms) * step_ms
    last = F.floor((F.col("ts_ms") + LOOKBACK_MS - 1) / step_ms) * step_ms
    ticks = F.when(last >= first, F.sequence(first, last, F.lit(step_ms).cast("bigint")))
    return samples.select("*", F.explode(ticks).alias("eval_ms"))


def at_times(samples: DataFrame, evals: DataFrame) -> DataFrame:
    """Samples under the given evaluation times ``(instance, eval_ms)`` that look at them.

    An equi-join on instance and 5-minute bucket: an evaluation meets its own bucket and the one
    before, nothing else.  Evaluation times are made distinct first.
    """
    bucket = F.floor(F.col("eval_ms") / LOOKBACK_MS)
    wanted = evals.select("instance", "eval_ms").distinct().select(
        "instance", "eval_ms", F.explode(F.array(bucket - 1, bucket)).alias("bucket")
    )
    placed = samples.withColumn("bucket", F.floor(F.col("ts_ms") / LOOKBACK_MS))
    seen = (F.col("ts_ms") <= F.col("eval_ms")) & (F.col("ts_ms") > F.col("eval_ms") - LOOKBACK_MS)
    return placed.join(wanted, ["instance", "bucket"]).filter(seen).drop("bucket")


def _series_rates(seen: DataFrame) -> DataFrame:
    """Both rates of each series at each evaluation time, from samples placed under those times."""
    keys = [*SERIES, "eval_ms"]
    series = Window.partitionBy(*keys).orderBy("ts_ms")
    steps = seen.select(
        *keys, "ts_ms", "value",
        F.lag("ts_ms").over(series).alias("before_ms"),
        _increase(F.lag("value").over(series), F.col("value")).alias("step"),
    )
    edge = f"(eval_ms - {RATE_MS})"
    newest = "max(struct(ts_ms, before_ms, step, value))"
    first, last = (f"{f}(if(ts_ms > {edge}, ts_ms, NULL))" for f in ("min", "max"))
    return steps.groupBy(*keys).agg(*map(F.expr, [
        f"try_divide(sum(if(before_ms > {edge}, step, NULL)), ({last} - {first}) / 1000) AS rate",
        f"try_divide({newest}.step, ({newest}.ts_ms - {newest}.before_ms) / 1000) AS irate",
        f"{newest}.value AS latest",
    ]))


# Percent of time of a CPU mode, from the rates of its cores.
USAGE = "round(coalesce(sum(rate), sum(irate)) * 100 / count(*), 6)"


def cpu_usage(seen: DataFrame) -> DataFrame:
    """Percent of time per CPU mode; which rate is used is decided per mode, after the sum over cores."""
    cpu = seen.filter((F.col("metric") == CPU) & F.col("mode").isin(CPU_MODES))
    return (
        _series_rates(cpu)
        .groupBy("instance", "eval_ms", "mode")
        .agg(F.expr(f"{USAGE} AS usage"))
        .filter("usage IS NOT NULL")
    )


def host_cpu_usage(samples: DataFrame, names: DataFrame, step_ms: int = LOOKBACK_MS) -> DataFrame:
    """CPU usage of every host at every tick."""
    return names.groupBy(F.col("nodename").alias("host")).agg(F.min("instance").alias("instance")).join(
        cpu_usage(at_ticks(samples, step_ms)), "instance"
    ).select("host", "eval_ms", "mode", "usage")


def _latest(hosts: DataFrame, names: DataFrame, samples: DataFrame, metrics: dict[str, str], at_ms: int | None, step_ms: int) -> DataFrame:
    """Latest value of some metrics per host and evaluation time, as columns; older than the look-back is nothing.

    At one given time every host has a row; else there is one per tick at which any of the metrics is known.  Values are
    combined before the shuffle.
    """
    kept = samples.filter(F.col("metric").isin(list(metrics.values())))
    if at_ms is None:
        kept, how = at_ticks(kept, step_ms), "inner"
    else:
        kept, how = kept.filter((F.col("ts_ms") <= at_ms) & (F.col("ts_ms") > at_ms - LOOKBACK_MS)).withColumn("eval_ms", F.lit(at_ms).cast("bigint")), "left"
    latest = kept.groupBy("instance", "eval_ms").agg(
        *[
            F.max_by("value", F.when(F.col("metric") == name, F.col("ts_ms"))).alias(out)
            for out, name in metrics.items()
        ]
    )
    found = resolve_hosts(hosts, names).join(latest, "instance", how)
    return found if at_ms is None else found.withColumn("eval_ms", F.lit(at_ms).cast("bigint"))


def host_load(hosts: DataFrame, names: DataFrame, samples: DataFrame, at_ms: int | None = None, step_ms: int = LOOKBACK_MS) -> DataFrame:
    """Load averages of each host at a time, or at every tick; null is one without an instance or a sample of the last 5 minutes."""
    return _latest(hosts, names, samples, LOADS, at_ms, step_ms).select("host", "eval_ms", *LOADS)


def host_memory_available(
    hosts: DataFrame, names: DataFrame, samples: DataFrame, at_ms: int | None = None, step_ms: int = LOOKBACK_MS
) -> DataFrame:
    """Available memory, else free + buffers + cached, else 0, of each host at a time, or at every tick."""
    parts = {"available": AVAILABLE, "free": FREE_PARTS[0], "buffers": FREE_PARTS[1], "cached": FREE_PARTS[2]}
    memory = F.coalesce(
        F.col("available"), F.col("free") + F.col("buffers") + F.col("cached"), F.lit(0.0)
    )
    return _latest(hosts, names, samples, parts, at_ms, step_ms).select(
        "host", "eval_ms", F.floor(memory).cast("bigint").alias("available_bytes")
    )


def host_io_rate(
    hosts: DataFrame, names: DataFrame, samples: DataFrame, step_ms: int = LOOKBACK_MS
) -> DataFrame:
    """Bytes per second paged in and out, per host and tick at which either is known; missing is 0."""
    pages = at_ticks(samples.filter(F.col("metric").isin(PAGE_IN, PAGE_OUT)), step_ms)
    rate = F.coalesce("rate", "irate") * PAGE_BYTES
    rates = (
        _series_rates(pages)
        .groupBy("instance", "eval_ms")
        .agg(*[
            F.round(F.coalesce(F.max(F.when(F.col("metric") == m, rate)), F.lit(0.0)), 6).alias(out)
            for out, m in (("page_in", PAGE_IN), ("page_out", PAGE_OUT))
        ])
    )
    return resolve_hosts(hosts, names).join(rates, "instance").select("host", "eval_ms", "page_in", "page_out")


def host_state_asof(probes: DataFrame, names: DataFrame, samples: DataFrame) -> DataFrame:
    """Load and CPU usage of a host as they were at the time of each probe ``(host, eval_ms)``.

    Values older than the look-back are unknown.  One row per distinct probe; unknown is null.
    """
    placed = resolve_hosts(probes.select("host", "eval_ms").distinct(), names)
    wanted = samples.filter(
        F.col("metric").isin(*LOADS.values()) | ((F.col("metric") == CPU) & F.col("mode").isin(CPU_MODES))
    )
    seen = at_times(wanted, placed.filter("instance IS NOT NULL"))
    # One pass for all of it: series, then metric and mode, then columns.
    per_mode = _series_rates(seen).groupBy("instance", "eval_ms", "metric", "mode").agg(
        F.expr(f"{USAGE} AS usage"), F.max("latest").alias("latest")
    )
    columns = [f"max(if(metric = '{name}', latest, NULL)) AS {out}" for out, name in LOADS.items()]
    columns += [f"max(if(mode = '{mode}', usage, NULL)) AS `{mode}`" for mode in CPU_MODES]
    state = per_mode.groupBy("instance", "eval_ms").agg(*map(F.expr, columns))
    return placed.join(state, ["instance", "eval_ms"], "left").select("host", "eval_ms", *LOADS, *CPU_MODES)
