"""Streaming monitors.

Stateless work (heap alerts, task failures) is a projection.  Counts are streaming aggregations with
a watermark, so old state goes.  Throttling runs the batch operator per micro-batch over a small
carried table.  The lost-executor counter uses Python state; stages that are judged
as their news comes in, open or completed, are in :mod:`stage_state`, executors that leave in :mod:`executor_state`.
File streams see a file once: only finished files may be moved into a landing folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import executors, failures, throttle
from ..schemas import EXECUTOR_KEYS, STAGE_KEYS
from ..settings import Thresholds
from ..sinks.delivery import META_SERVER, deliver
from .state import BatchTable, append_batch, run

# Fixed value: the evaluation period.  LATENESS is the default of how late a row may be before it is left out.
HEAP_PERIOD = "10 seconds"
LATENESS = "10 minutes"
COUNT_WINDOW = "10 minutes"


def stage_progress(updates: DataFrame, out_path: str, checkpoint: str, every: str | None = None, lateness: str = LATENESS) -> StreamingQuery:
    """Ended attempts per stage attempt, per 10-minute window of their end.

    The attempt is part of the key, so a retried stage starts from 0.  Windows behind the watermark
    leave the state, so finished stages do too.  Rows later than ``lateness`` are left out; their number
    is ``numRowsDroppedByWatermark`` of the query's progress.  Each trigger writes the counts that changed.
    """
    ended = updates.filter(F.col("status") != "RUNNING").withColumn("ended_at", F.timestamp_millis("finish_ms"))
    counts = (
        ended.withWatermark("ended_at", lateness)
        .groupBy(F.window("ended_at", COUNT_WINDOW).alias("w"), *STAGE_KEYS)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*STAGE_KEYS, F.unix_millis("w.start").alias("window_ms"), "n")
    )
    return run(counts, lambda df, i: append_batch(df, out_path, i), checkpoint, "update", every)


def progress_totals(written: DataFrame) -> DataFrame:
    """Ended attempts per stage from what :func:`stage_progress` wrote: last count of each window, summed."""
    last = F.max(F.struct("batch_id", "n"))["n"].alias("n")
    per_window = written.groupBy(*STAGE_KEYS, "window_ms").agg(last)
    return per_window.groupBy(*STAGE_KEYS).agg(F.sum("n").alias("n_finished"))


def heap_alerts(
    samples: DataFrame, out_path: str, checkpoint: str, app_configs: DataFrame | None = None,
    th: Thresholds = Thresholds(), every: str | None = None,
) -> StreamingQuery:
    """Heap pressure alerts as samples arrive, against the configured memory where ``app_configs`` is given."""
    alerts = executors.heap_pressure(samples, app_configs, th)
    return run(alerts, lambda df, i: append_batch(df, out_path, i), checkpoint, every=every)


def heap_stats(
    samples: DataFrame, out_path: str, checkpoint: str, every: str | None = None, lateness: str = LATENESS
) -> StreamingQuery:
    """Heap statistics per executor and 10-minute window; windows behind the watermark leave the state.

    Rows later than ``lateness`` are left out and counted, as in :func:`stage_progress`.
    """
    stats = (
        samples.withColumn("at", F.timestamp_millis("ts_ms"))
        .withWatermark("at", lateness)
        .groupBy(F.window("at", COUNT_WINDOW).alias("w"), *EXECUTOR_KEYS)
        .agg(
            F.min("heap_used").alias("min_heap"), F.max("heap_used").alias("max_heap"),
            F.sum("heap_used").alias("total_heap"), F.count("heap_used").alias("samples"),
        )
        .select(*EXECUTOR_KEYS, F.unix_millis("w.start").alias("window_ms"),
                "min_heap", "max_heap", "total_heap", "samples")
    )
    return run(stats, lambda df, i: append_batch(df, out_path, i), checkpoint, "update", every)


def heap_totals(written: DataFrame) -> DataFrame:
    """Heap statistics per executor from the windows :func:`heap_stats` wrote."""
    parts = ["min_heap", "max_heap", "total_heap", "samples"]
    last = F.max(F.struct("batch_id", *parts)).alias("last")
    per_window = written.groupBy(*EXECUTOR_KEYS, "window_ms").agg(last).select(*EXECUTOR_KEYS, "last.*")
    return per_window.groupBy(*EXECUTOR_KEYS).agg(
        F.min("min_heap").alias("min_heap"), F.max("max_heap").alias("max_heap"),
        F.sum("total_heap").alias("total_heap"), F.sum("samples").alias("samples"),
    ).withColumn("avg_heap", F.expr("total_heap div nullif(samples, 0)"))


COUNTERS = "app_id string, throttle_group string, counter_executor string, fired bigint, last_ms bigint"
# How long a counter is kept after the last it counted, on the clock of what is counted.
KEEP_MS = 6 * 3_600_000


def throttled_alerts(
    alerts: DataFrame,
    state_path: str,
    out_path: str,
    checkpoint: str,
    periods: dict[str, int] | None = None,
    every: str | None = None,
    keep_ms: int = KEEP_MS,
    ended: Callable[[SparkSession], DataFrame] | None = None,
) -> StreamingQuery:
    """Alert throttling over a stream.

    Per micro-batch the alerts are numbered by the batch operator, in their order inside the batch,
    and continue the carried counters (one row each).  Counters leave ``keep_ms`` after their last alert, and at once
    when their application (``app_id``) is in the table that ``ended`` gives.
    """
    table = BatchTable(state_path, COUNTERS)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = table.before(spark, batch_id)
        # The batch is read several times; alerts are few, so it is kept for the time being.
        batch.persist()
        numbered = throttle.numbered(batch)
        here = numbered.groupBy(*throttle.COUNTER).agg(F.count(F.lit(1)).alias("fired"), F.max("eval_ms").alias("last_ms"))
        fired = before.unionByName(here).groupBy(*throttle.COUNTER).agg(F.sum("fired").alias("fired"), F.max("last_ms").alias("last_ms"))
        newest = batch.agg(F.max("eval_ms")).first()[0]
        kept = fired if newest is None else fired.filter(F.col("last_ms") > newest - keep_ms)
        if ended is not None:
            kept = kept.join(ended(spark).select("app_id").distinct(), "app_id", "left_anti")
        table.write(kept.select(*fired.columns), batch_id)
        continued = numbered.join(before.drop("last_ms"), throttle.COUNTER, "left")
        passed = continued.filter(throttle.passes("(firing + coalesce(fired, 0L))", periods))
        append_batch(
            passed.select(*batch.columns).unionByName(throttle.unthrottled(batch)), out_path, batch_id
        )
        batch.unpersist()

    return run(alerts, on_batch, checkpoint, every=every)


LOST_STATE = "failed bigint, last_ms bigint"
LOST_ROWS = "app_id string, executor_id string, ts_ms bigint, failed_polls bigint"


def _count_failures(lost_polls: int, keep_ms: int):
    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failed, last = state.get if state.exists else (0, 0)
        # Only the first few failures matter, so no more of them are held than are still missing.
        missing = max(lost_polls - failed, 0)
        first = pd.Series([], dtype="int64")
        total = 0
        for chunk in chunks:
            total += len(chunk)
            last = max(last, int(chunk["ts_ms"].max()))
            first = pd.concat([first, chunk["ts_ms"]]).nsmallest(missing) if missing else first
        state.update((failed + total, last))
        state.setTimeoutTimestamp(max(last + keep_ms, state.getCurrentWatermarkMs() + 1))
        if missing and total >= missing:
            yield pd.DataFrame(
                {"app_id": [key[0]], "executor_id": [key[1]], "ts_ms": [int(first.iloc[missing - 1])],
                 "failed_polls": [lost_polls]}
            )

    return step


def lost_executors(
    polls: DataFrame, out_path: str, checkpoint: str, th: Thresholds = Thresholds(), every: str | None = None,
    lateness: str = LATENESS, keep_ms: int = KEEP_MS,
) -> StreamingQuery:
    """An executor's third failed poll, once; a success in between changes nothing.

    The counter of an executor leaves when the watermark is ``keep_ms`` past its last failed poll; polls later than
    ``lateness`` are left out and counted, as in :func:`stage_progress`.
    """
    # Before the first batch the watermark is the epoch, and what is not after it counts as late.
    at = F.timestamp_millis(F.col("ts_ms") + 1).alias("at")
    failed = polls.filter("NOT ok").select(*EXECUTOR_KEYS, "ts_ms", at).withWatermark("at", lateness)
    lost = failed.groupBy(*EXECUTOR_KEYS).applyInPandasWithState(
        _count_failures(th.lost_polls, keep_ms), LOST_ROWS, LOST_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return run(lost, lambda df, i: append_batch(df, out_path, i), checkpoint, "append", every)


def task_failures(updates: DataFrame, out_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """TASK_FAILED events and failure causes as attempts fail."""
    alerts = failures.failure_alerts(updates)
    return run(alerts, lambda df, i: append_batch(df, out_path, i), checkpoint, every=every)


def delivered(
    records: DataFrame,
    log_path: str,
    checkpoint: str,
    sink_type: str = META_SERVER,
    address: str | None = None,
    epoch_s: int | str = "eval_ms div 1000",
    every: str | None = None,
) -> StreamingQuery:
    """Routes a stream of records to the log and the external sink, one folder per micro-batch."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        part = f"batch_id={batch_id}"
        outside = f"{address.rstrip('/')}/{part}" if address else None
        deliver(batch, f"{log_path.rstrip('/')}/{part}", sink_type, outside, epoch_s, "overwrite")

    return run(records, on_batch, checkpoint, every=every)
