"""Executors: heap statistics, pressure alerts, lost executors and the roll-up at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import fmt_bytes_sql
from ..functions.text import message_sql, time_sql
from ..schemas import EXECUTOR_KEYS
from ..settings import RULE_ORDER, Thresholds
from .failures import DEFAULT_MEMORY
from .skew import running_total
from .tasks import READ_BYTES, metric

# Event name, the id of the driver, which is not an executor, and message templates.
EXECUTOR_INFO = "EXECUTOR_INFO"
DRIVER = "driver"
PRESSURE_TEXT = "executor_{executor_id} max memory is {limit}, current heap memory is {heap}"
LOST_TEXT = "lost executor_{executor_id} {polls} times, jvm info: {info}"
HEAP_TEXT = "min heap memory: {low}; average heap memory: {mean}; max heap memory: {high} "
# Polls of one executor within this time are counted in one task.
SLICE_MS = 3_600_000


def executor_inventory(executors: DataFrame) -> DataFrame:
    return executors.filter(f"executor_id <> '{DRIVER}'").select(*EXECUTOR_KEYS, "host")


def heap_stats(samples: DataFrame) -> DataFrame:
    """Minimum, maximum, total, count and whole-number average of the heap of each executor."""
    return samples.groupBy(*EXECUTOR_KEYS).agg(*map(F.expr, [
        "min(heap_used) AS min_heap", "max(heap_used) AS max_heap", "sum(heap_used) AS total_heap",
        "count(heap_used) AS samples", "sum(heap_used) div nullif(count(heap_used), 0) AS avg_heap",
    ]))


def heap_text() -> str:
    """SQL for heap statistics as text, over the columns of :func:`heap_stats`."""
    return message_sql(
        HEAP_TEXT, low=fmt_bytes_sql("min_heap"), mean=fmt_bytes_sql("avg_heap"), high=fmt_bytes_sql("max_heap")
    )


def _alerts(df: DataFrame, rule: str, level: str, message: str) -> DataFrame:
    return df.selectExpr(
        "app_id", "int(NULL) AS stage_id", "int(NULL) AS stage_attempt_id", f"'{EXECUTOR_INFO}' AS event",
        f"'{level}' AS level", f"'{rule}' AS rule", "bigint(NULL) AS task_id", "executor_id", "ts_ms AS eval_ms",
        f"{RULE_ORDER[rule]} AS rule_ord", f"{message} AS message",
    )


def heap_pressure(
    samples: DataFrame, app_configs: DataFrame | None = None, th: Thresholds = Thresholds()
) -> DataFrame:
    """Samples whose heap fills most of the executor memory (1 GiB where no setting is known).

    Without ``app_configs`` the limit is a constant and the rule a plain filter on the scan.
    """
    limit = f"{DEFAULT_MEMORY}L"
    if app_configs is not None:
        samples = samples.join(app_configs.select("app_id", "executor_memory"), "app_id", "left")
        limit = f"coalesce(executor_memory, {limit})"
    message = message_sql(PRESSURE_TEXT, limit=fmt_bytes_sql(limit), heap=fmt_bytes_sql("heap_used"))
    full = samples.filter(f"double(heap_used) / double({limit}) > {th.heap_ratio!r}D")
    return _alerts(full, "heap_pressure", "WARN", message)


def latest_samples(samples: DataFrame) -> DataFrame:
    """Newest sample of each executor, combined before the shuffle."""
    others = [c for c in samples.columns if c not in (*EXECUTOR_KEYS, "ts_ms")]
    if len(others) == 1:
        # Two plain numbers per group: aggregated by hash, without a sort.
        return samples.groupBy(*EXECUTOR_KEYS).agg(
            F.max("ts_ms").alias("ts_ms"), F.max_by(others[0], "ts_ms").alias(others[0])
        )
    newest = F.max(F.struct("ts_ms", *others)).alias("newest")
    return samples.groupBy(*EXECUTOR_KEYS).agg(newest).select(*EXECUTOR_KEYS, "newest.*")


def poll_failures(polls: DataFrame) -> DataFrame:
    """Every poll with the number of failed polls of its executor so far.

    An executor's polls are counted by the hour, hours are then added up, so no task sees more than
    an hour of polls of one executor.
    """
    return running_total(
        polls, EXECUTOR_KEYS, [f"ts_ms div {SLICE_MS}"], ["ts_ms"], "if(ok, 0, 1)", "failed_polls"
    )


def lost_executors(
    polls: DataFrame, samples: DataFrame | None = None, th: Thresholds = Thresholds()
) -> DataFrame:
    """The failed poll at which an executor counts as lost; a success in between changes nothing.

    Only failed polls are shuffled, and at most ``lost_polls`` per executor and input partition.
    The heap text is empty for an executor that was never sampled.
    """
    order = Window.partitionBy(*EXECUTOR_KEYS).orderBy("ts_ms")
    failed = polls.filter("NOT ok").select(*EXECUTOR_KEYS, "ts_ms", F.row_number().over(order).alias("nth"))
    # The bound lets Spark cut each partition to its first polls; the equality alone would not.
    lost = failed.filter(F.col("nth") <= th.lost_polls).filter(F.col("nth") == th.lost_polls)
    if samples is None:
        known = lost.withColumn("info", F.lit(""))
    else:
        known = lost.join(heap_stats(samples).selectExpr(*EXECUTOR_KEYS, f"{heap_text()} AS info"), EXECUTOR_KEYS, "left")
    return _alerts(known, "executor_lost", "ERROR", message_sql(LOST_TEXT, polls=str(th.lost_polls)))


def with_heap(rollup: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds average and maximum heap; 0 for executors that were never sampled."""
    heap = heap_stats(samples).select(*EXECUTOR_KEYS, "avg_heap", "max_heap")
    return rollup.join(heap, EXECUTOR_KEYS, "left").fillna(0, ["avg_heap", "max_heap"])


def executor_work(tasks: DataFrame) -> DataFrame:
    """Completed and failed attempts and bytes read, per executor."""
    return tasks.groupBy(*EXECUTOR_KEYS).agg(*map(F.expr, [
        "count_if(status = 'SUCCESS') AS completed_tasks", "count_if(status = 'FAILED') AS failed_tasks",
        f"sum({metric('input_bytes')}) AS input_bytes", f"sum({READ_BYTES}) AS shuffle_read_bytes",
    ]))


def executor_rollup(
    executors: DataFrame, tasks: DataFrame, samples: DataFrame, end_ms: int | str
) -> DataFrame:
    """What each executor did: when it was removed or, if still there, at the application's end.

    The executor table leads, so a task on an unknown executor makes no row.
    """
    at = f"coalesce(removed_ms, {time_sql(end_ms)})"
    known = executors.filter(f"executor_id <> '{DRIVER}'").selectExpr(
        *EXECUTOR_KEYS, "host", f"{at} - added_ms AS elapsed_ms", f"{at} AS eval_ms"
    )
    work = ["completed_tasks", "failed_tasks", "input_bytes", "shuffle_read_bytes"]
    joined = known.join(executor_work(tasks), EXECUTOR_KEYS, "left").fillna(0, work)
    return with_heap(joined, samples)
