"""Test tables as telemetry tables.

Each view turns ``orders``, ``events`` or ``part`` into a telemetry table.  The SQL runs unchanged in
Spark and DuckDB; :func:`with_views` puts the views a query needs in front of it as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVAL_MS = 1704067200000
# Time at which many stages are half finished.
HALF_MS = EVAL_MS - 24000
BASE_TABLES = ["orders", "events", "part"]

VIEWS = {
    "fx_base": """
SELECT o_orderkey AS task_id, CAST(o_custkey % 48 AS INT) AS stage_id, CAST(floor(o_totalprice) AS BIGINT) AS v,
  CASE WHEN o_orderstatus = 'P' THEN 'RUNNING'
       WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'FAILED'
       WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'KILLED' ELSE 'SUCCESS' END AS status
FROM orders""",
    "fx_metrics": """
SELECT task_id, stage_id, status,
  CASE stage_id % 7 WHEN 0 THEN 30000 + v % 100 WHEN 1 THEN CAST(floor(v * 10000 / 100000) AS BIGINT)
    WHEN 2 THEN CAST(floor(v / 1000) AS BIGINT) WHEN 3 THEN 100000 + CAST(floor(v * 10000 / 100000) AS BIGINT)
    WHEN 4 THEN CASE WHEN task_id % 97 = 0 THEN 400000 ELSE 30000 END
    WHEN 6 THEN CASE WHEN task_id % 10 < 3 THEN 60000 ELSE 10000 END
    ELSE CASE WHEN task_id % 97 = 0 THEN 30000 ELSE 0 END END AS time_ms,
  CASE (stage_id + 1) % 7 WHEN 0 THEN 15000 + v % 100 WHEN 1 THEN CAST(floor(v * 5000 / 100000) AS BIGINT)
    WHEN 2 THEN CAST(floor(v / 1000) AS BIGINT) WHEN 3 THEN 50000 + CAST(floor(v * 5000 / 100000) AS BIGINT)
    WHEN 4 THEN CASE WHEN task_id % 89 = 0 THEN 200000 ELSE 15000 END
    WHEN 6 THEN CASE WHEN task_id % 10 < 3 THEN 30000 ELSE 5000 END
    ELSE CASE WHEN task_id % 89 = 0 THEN 15000 ELSE 0 END END AS input_records,
  CASE (stage_id + 2) % 7 WHEN 0 THEN 6000 + v % 100 WHEN 1 THEN CAST(floor(v * 2000 / 100000) AS BIGINT)
    WHEN 2 THEN CAST(floor(v / 1000) AS BIGINT) WHEN 3 THEN 20000 + CAST(floor(v * 2000 / 100000) AS BIGINT)
    WHEN 4 THEN CASE WHEN task_id % 97 = 0 THEN 80000 ELSE 6000 END
    WHEN 6 THEN CASE WHEN task_id % 10 < 3 THEN 12000 ELSE 2000 END
    ELSE CASE WHEN task_id % 97 = 0 THEN 6000 ELSE 0 END END AS shuffle_read_records,
  CASE (stage_id + 3) % 7 WHEN 0 THEN 6000 + v % 100 WHEN 1 THEN CAST(floor(v * 2000 / 100000) AS BIGINT)
    WHEN 2 THEN CAST(floor(v / 1000) AS BIGINT) WHEN 3 THEN 20000 + CAST(floor(v * 2000 / 100000) AS BIGINT)
    WHEN 4 THEN CASE WHEN task_id % 83 = 0 THEN 80000 ELSE 6000 END
    WHEN 6 THEN CASE WHEN task_id % 10 < 3 THEN 12000 ELSE 2000 END
    ELSE CASE WHEN task_id % 83 = 0 THEN 6000 ELSE 0 END END AS shuffle_write_records
FROM fx_base""",
    "fx_tasks": """
SELECT 'app_' || (stage_id % 4) AS app_id, stage_id, 0 AS stage_attempt_id, task_id,
  CAST(task_id % 12 AS STRING) AS executor_id, 'host_' || (task_id % 12 % 5) AS host, status,
  1704067200000 - time_ms - CASE WHEN status = 'RUNNING' THEN 0 ELSE (task_id % 100) * 1000 END AS launch_ms,
  CASE WHEN status = 'RUNNING' THEN NULL ELSE 1704067200000 - (task_id % 100) * 1000 END AS finish_ms,
  CASE WHEN status = 'RUNNING' THEN NULL ELSE time_ms END AS duration_ms,
  CASE WHEN stage_id % 5 = 0 THEN CAST(floor(time_ms * 3 / 5) AS BIGINT) ELSE CAST(floor(time_ms * 19 / 20) AS BIGINT) END AS run_ms,
  CAST(0 AS BIGINT) AS deserialize_ms, CAST(0 AS BIGINT) AS result_ser_ms, CAST(0 AS BIGINT) AS getting_result_ms,
  CASE WHEN task_id % 97 = 0 THEN CAST(floor(time_ms * 8 / 10) AS BIGINT) ELSE CAST(floor(time_ms / 20) AS BIGINT) END AS gc_ms,
  input_records, input_records * 200 AS input_bytes, input_records * 10 AS output_bytes,
  shuffle_read_records, shuffle_read_records * 60 AS shuffle_local_bytes, shuffle_read_records * 40 AS shuffle_remote_bytes,
  shuffle_write_records, shuffle_write_records * 100 AS shuffle_write_bytes,
  CASE WHEN status = 'KILLED' THEN 'TaskKilled (another attempt succeeded)'
       WHEN status <> 'FAILED' THEN NULL
       WHEN task_id % 5 = 0 THEN 'ExecutorLostFailure (executor ' || (task_id % 12) || ' exited caused by one of the running tasks) Reason: Container marked as failed. Exit code is 143'
       WHEN task_id % 5 = 1 THEN 'org.apache.spark.shuffle.FetchFailedException: Failed to connect to host_' || (task_id % 12 % 5)
       WHEN task_id % 5 = 2 THEN 'ExecutorLostFailure (executor ' || (task_id % 12) || ' exited unrelated to the running tasks) Reason: heartbeat timed out'
       WHEN task_id % 5 = 3 THEN 'org.apache.spark.shuffle.FetchFailedException: stream is corrupted'
       ELSE 'java.lang.ArithmeticException: / by zero' END AS failure_reason
FROM fx_metrics""",
    "fx_stages": """
SELECT app_id, stage_id, stage_attempt_id, 'stage_' || stage_id AS name, count(*) AS num_tasks, min(launch_ms) AS submission_ms,
  CASE WHEN stage_id % 2 = 1 THEN 1704067200000 END AS completion_ms,
  CASE WHEN stage_id % 8 = 7 THEN 'aborted' END AS failure_reason
FROM fx_tasks GROUP BY app_id, stage_id, stage_attempt_id""",
    "fx_stage_parents": """
SELECT app_id, stage_id, stage_id - 4 AS parent_id FROM fx_stages WHERE stage_id % 3 <> 0
UNION ALL SELECT app_id, stage_id, stage_id + 1000 AS parent_id FROM fx_stages WHERE stage_id % 3 = 2""",
    "fx_executors": """
SELECT DISTINCT app_id, executor_id, host, 2 AS cores, 1704067200000 - 3600000 AS added_ms,
  CASE WHEN CAST(executor_id AS INT) % 3 = 0 THEN NULL ELSE 1704067200000 - CAST(executor_id AS INT) * 60000 END AS removed_ms
FROM fx_tasks
UNION ALL SELECT DISTINCT app_id, 'driver', 'host_9', 1, 1704067200000 - 3600000, CAST(NULL AS BIGINT) FROM fx_tasks""",
    "fx_conf": """
SELECT t.app_id, t.key, t.value FROM (SELECT DISTINCT app_id FROM fx_tasks) a JOIN (VALUES ('app_0','spark.executor.memory','4g'), ('app_0','spark.dynamicAllocation.enabled','true'),
  ('app_0','spark.dynamicAllocation.maxExecutors','40'), ('app_1','spark.executor.memory','2048m'),
  ('app_1','spark.executor.instances','12'), ('app_1','spark.sql.shuffle.partitions','64'),
  ('app_2','spark.driver.memory','1073741824'), ('app_3','spark.executor.cores','4')) AS t(app_id, key, value) ON a.app_id = t.app_id""",
    # Settings of many applications, every one with some of the keys, as texts of several forms.
    "fx_settings": """
SELECT 'job_' || CAST(floor(p_partkey / 5) AS BIGINT) AS app_id,
  CASE p_partkey % 7 WHEN 0 THEN 'spark.executor.memory' WHEN 1 THEN 'spark.driver.memory' WHEN 2 THEN 'spark.executor.cores'
    WHEN 3 THEN 'spark.sql.shuffle.partitions' WHEN 4 THEN 'spark.dynamicAllocation.enabled'
    WHEN 5 THEN 'spark.dynamicAllocation.maxExecutors' ELSE 'spark.executor.instances' END AS key,
  CASE WHEN p_partkey % 7 <= 1 THEN p_size || CASE p_size % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'm' ELSE '' END
    WHEN p_partkey % 7 = 4 THEN CASE WHEN p_size % 3 = 0 THEN 'false' ELSE 'true' END
    WHEN p_size % 11 = 0 THEN 'many' ELSE '' || p_size END AS value
FROM part""",
    "fx_apps": """
SELECT app_id, 'job of ' || app_id AS app_name, 'analyst' AS user_name, 'default' AS queue,
  min(launch_ms) - 60000 AS submit_ms, min(launch_ms) - 30000 AS start_ms, CAST(NULL AS BIGINT) AS end_ms
FROM fx_tasks GROUP BY app_id""",
    "fx_rdds": """
SELECT CAST(p_partkey % 48 AS INT) AS stage_id, p_partkey AS rdd_id, 'op at job.py:' || p_partkey AS callsite FROM part""",
    # A third of the links lead to a higher id, as after a checkpoint; no walk comes back to where it was.
    "fx_rdd_parents": """
SELECT CAST(p_partkey % 48 AS INT) AS stage_id, p_partkey AS rdd_id, p_partkey + CASE WHEN p_size % 10 = 1 THEN -47 WHEN CAST(floor(p_partkey / 48) AS BIGINT) % 3 = 1 THEN 48 ELSE -96 END AS parent_id FROM part
UNION ALL SELECT CAST(p_partkey % 48 AS INT), p_partkey, p_partkey - 96 FROM part WHERE p_size % 10 = 0""",
    # The tables made from events share one clock: event n happens in second n.
    "fx_samples": """
SELECT 'app_' || (user_id % 4) AS app_id, CAST(user_id % 12 AS STRING) AS executor_id, event_id * 1000 AS ts_ms,
  CAST(floor(value * 4194304) AS BIGINT) AS heap_used FROM events""",
    "fx_polls": """
SELECT 'app_' || (user_id % 4) AS app_id, CAST(user_id % 12 AS STRING) AS executor_id, event_id * 1000 AS ts_ms,
  (event_type <> 'error' OR user_id % 12 >= 10) AS ok FROM events""",
    "fx_host_samples": """
SELECT '10.0.0.' || (user_id % 5) || ':9100' AS instance, event_id * 1000 AS ts_ms,
  CASE event_type WHEN 'click' THEN 'node_load1' WHEN 'view' THEN 'node_load5'
    WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'node_vmstat_pgpgin' WHEN 1 THEN 'node_vmstat_pgpgout' ELSE 'node_load15' END
    WHEN 'signup' THEN 'node_cpu'
    ELSE CASE WHEN event_id % 4 = 0 AND user_id % 5 < 3 THEN 'node_memory_MemAvailable' WHEN event_id % 4 < 2 THEN 'node_memory_MemFree'
      WHEN event_id % 4 = 2 THEN 'node_memory_Buffers' ELSE 'node_memory_Cached' END END AS metric,
  CASE WHEN event_type = 'signup' THEN CASE event_id % 4 WHEN 0 THEN 'system' WHEN 1 THEN 'idle' WHEN 2 THEN 'user' ELSE 'iowait' END END AS mode,
  CASE WHEN event_type = 'signup' THEN CAST(event_id % 2 AS STRING) END AS cpu,
  CASE WHEN event_type IN ('signup', 'purchase') THEN (event_id % 500) * 0.5e0 ELSE value END AS value
FROM events""",
    # The same samples on the clock of the tasks: the last one lies at the evaluation time.
    "fx_host_clock": """
SELECT instance, ts_ms + 1704067200000 - (SELECT max(event_id) FROM events) * 1000 AS ts_ms, metric, mode, cpu, value
FROM fx_host_samples""",
    "fx_host_names": """
SELECT DISTINCT 'host_' || (user_id % 5) AS nodename, '10.0.0.' || (user_id % 5) || ':9100' AS instance FROM events WHERE user_id % 5 < 4""",
}


def _needed(sql: str, views: dict[str, str]) -> list[str]:
    """Views a text refers to, directly or through other views, in order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        for name in re.findall(r"\b[fo]x_\w+", todo.pop()):
            if name in views and name not in found:
                found.add(name)
                todo.append(views[name])
    return [name for name in views if name in found]


def with_views(sql: str, more: dict[str, str] | None = None) -> str:
    """The query with its views as CTEs; a query with CTEs of its own starts with ``WITH``."""
    known = {**VIEWS, **(more or {})}
    views = [f"{name} AS ({known[name].strip()})" for name in _needed(sql, known)]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*views, body[5:]])
    return "WITH " + ",\n".join(views) + "\n" + body if views else body


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sql_over(spark: SparkSession, sql: str, base: Callable[[str], DataFrame]) -> DataFrame:
    """Runs view SQL over base tables."""
    text = with_views(sql)
    used = {}
    for name in BASE_TABLES:
        text, n = re.subn(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)
        if n:
            used[name] = base(name)
    return spark.sql(text, **used)


_DEFINED: dict[int, tuple[SparkSession, dict[str, Tables]]] = {}


class Tables:
    """The telemetry tables of one test directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, **replaced: DataFrame):
        self.spark = spark
        self.sf_dir = sf_dir
        self._base = dict(replaced)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Tables:
        """The tables of a directory, defined once per session."""
        known = _DEFINED.setdefault(id(spark), (spark, {}))[1]
        return known.setdefault(sf_dir, cls(spark, sf_dir))

    def base(self, name: str) -> DataFrame:
        if name not in self._base:
            self._base[name] = base_table(self.spark, self.sf_dir, name)
        return self._base[name]

    def view(self, name: str) -> DataFrame:
        return sql_over(self.spark, f"SELECT * FROM {name}", self.base)

    @cached_property
    def tasks(self) -> DataFrame:
        return self.view("fx_tasks")

    @cached_property
    def stages(self) -> DataFrame:
        return self.view("fx_stages")

    @cached_property
    def stages_with_parents(self) -> DataFrame:
        parents = self.view("fx_stage_parents").groupBy("app_id", "stage_id").agg(
            F.collect_list("parent_id").alias("parent_ids")
        )
        return self.stages.join(parents, ["app_id", "stage_id"], "left")

    @cached_property
    def executors(self) -> DataFrame:
        return self.view("fx_executors")

    @cached_property
    def conf(self) -> DataFrame:
        return self.view("fx_conf")

    @cached_property
    def apps(self) -> DataFrame:
        return self.view("fx_apps").withColumnRenamed("user_name", "user")

    @cached_property
    def rdds(self) -> DataFrame:
        """Lineage by stage; the views know no application, so it is taken from the stage id."""
        parents = self.view("fx_rdd_parents").groupBy("stage_id", "rdd_id").agg(
            F.collect_list("parent_id").alias("parent_ids")
        )
        return self.view("fx_rdds").join(parents, ["stage_id", "rdd_id"], "left").select(
            F.concat(F.lit("app_"), F.col("stage_id") % 4).alias("app_id"), "stage_id",
            F.lit(0).alias("stage_attempt_id"), "rdd_id", "parent_ids", "callsite",
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.view("fx_samples")

    @cached_property
    def polls(self) -> DataFrame:
        return self.view("fx_polls")

    @cached_property
    def host_samples(self) -> DataFrame:
        return self.view("fx_host_samples")

    @cached_property
    def host_clock(self) -> DataFrame:
        return self.view("fx_host_clock")

    @cached_property
    def host_names(self) -> DataFrame:
        return self.view("fx_host_names")
