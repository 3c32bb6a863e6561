"""Applications: configuration facts and the summary at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import parse_size
from ..functions.text import time_sql
from .failures import DEFAULT_MEMORY

# The settings that are read, and the defaults of those that are reported.
SETTINGS = {
    "driver_memory": "spark.driver.memory",
    "executor_memory": "spark.executor.memory",
    "executor_cores": "spark.executor.cores",
    "shuffle_partitions": "spark.sql.shuffle.partitions",
    "dynamic": "spark.dynamicAllocation.enabled",
    "max_executors": "spark.dynamicAllocation.maxExecutors",
    "instances": "spark.executor.instances",
}
DEFAULTS = {
    "driver_memory": DEFAULT_MEMORY,
    "executor_memory": DEFAULT_MEMORY,
    "executor_cores": 1,
    "shuffle_partitions": 200,
}
DEFAULT_EXECUTORS = 5


def app_configs(app_conf: DataFrame) -> DataFrame:
    """One row per application with the reported settings.

    ``max_dynamic_executors`` is set under dynamic allocation, ``executor_instances`` otherwise.
    """
    raw = app_conf.groupBy("app_id").agg(
        *[F.expr(f"max(if(key = '{key}', value, NULL)) AS {name}") for name, key in SETTINGS.items()]
    )

    def number(name: str, default: int) -> str:
        return f"coalesce(try_cast({name} AS int), {default})"

    sizes = [
        F.coalesce(parse_size(name), F.lit(DEFAULTS[name])).alias(name) for name in ("driver_memory", "executor_memory")
    ]
    counts = [f"{number(name, DEFAULTS[name])} AS {name}" for name in ("executor_cores", "shuffle_partitions")]
    dynamic = "coalesce(lower(dynamic) = 'true', false)"
    return raw.select(
        "app_id", *sizes, *map(F.expr, counts),
        F.expr(f"if({dynamic}, {number('max_executors', DEFAULT_EXECUTORS)}, NULL) AS max_dynamic_executors"),
        F.expr(f"if({dynamic}, NULL, {number('instances', DEFAULT_EXECUTORS)}) AS executor_instances"),
    )


def resource_seconds(executors: DataFrame, configs: DataFrame, end_ms: int | str) -> DataFrame:
    """Memory-seconds (MB) and core-seconds per application, over the life of every executor."""
    alive = f"(coalesce(removed_ms, {time_sql(end_ms)}) - added_ms) div 1000"
    per_app = executors.groupBy("app_id").agg(
        F.expr(f"sum({alive}) AS alive_seconds"), F.expr(f"sum({alive} * cores) AS vcore_seconds")
    )
    memory = f"coalesce(executor_memory, {DEFAULT_MEMORY}L) div 1048576"
    return per_app.join(configs.select("app_id", "executor_memory"), "app_id", "left").selectExpr(
        "app_id", f"alive_seconds * ({memory}) AS memory_seconds", "vcore_seconds"
    )


def app_summary(
    applications: DataFrame, configs: DataFrame, executors: DataFrame, end_ms: int | str
) -> DataFrame:
    """Start and end facts of each application; one still running is measured up to ``end_ms``."""
    end = f"coalesce(end_ms, {time_sql(end_ms)})"
    facts = applications.selectExpr(
        "app_id", "user", "queue", "submit_ms", "start_ms", f"{end} AS end_ms", f"{end} - start_ms AS elapsed_ms"
    )
    known = facts.join(configs, "app_id", "left").fillna(DEFAULTS)
    instances = f"coalesce(executor_instances, if(max_dynamic_executors IS NULL, {DEFAULT_EXECUTORS}, NULL))"
    return (
        known.withColumn("executor_instances", F.expr(instances))
        .join(resource_seconds(executors, configs, end_ms), "app_id", "left")
        .fillna(0, ["memory_seconds", "vcore_seconds"])
    )
