"""Roll-ups of executors as they leave, from one carried row per executor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.executors import DRIVER
from ..operators.tasks import READ_BYTES, metric
from ..schemas import EXECUTOR_KEYS
from .state import BatchTable, append_batch, run

# Fixed value: how late a row about an executor may be before its roll-up is made.
LATENESS_MS = 600_000
# How long it is remembered that an executor has been reported.
KEEP_MS = 6 * 3_600_000

_SUMS = ["completed_tasks", "failed_tasks", "input_bytes", "shuffle_read_bytes", "total_heap", "samples"]
_HIGHEST = ["host", "added_ms", "removed_ms", "end_ms", "max_heap", "last_ms", "reported"]
ROWS = (
    "app_id string, executor_id string, host string, added_ms bigint, removed_ms bigint, end_ms bigint, completed_tasks bigint, "
    "failed_tasks bigint, input_bytes bigint, shuffle_read_bytes bigint, total_heap bigint, samples bigint, max_heap bigint, "
    "last_ms bigint, reported boolean"
)


def _records(df: DataFrame, **given: str) -> DataFrame:
    columns = [part.split() for part in ROWS.split(", ")]
    empty = {**dict.fromkeys(_SUMS, "0L"), "reported": "false"}
    return df.selectExpr(*[f"CAST({given.get(n, empty.get(n, 'NULL'))} AS {kind}) AS {n}" for n, kind in columns])


def executor_records(executors: DataFrame, updates: DataFrame, samples: DataFrame, ends: DataFrame) -> DataFrame:
    """One stream of what is told of executors: added and removed, ended attempts, heap samples, ends of applications."""
    keys = {"app_id": "app_id", "executor_id": "executor_id"}
    return (
        _records(executors.filter(f"executor_id <> '{DRIVER}'"), **keys, host="host", added_ms="added_ms", removed_ms="removed_ms",
                 last_ms="coalesce(removed_ms, added_ms)")
        .unionByName(_records(
            updates.filter("status <> 'RUNNING'"), **keys, completed_tasks="int(status = 'SUCCESS')", failed_tasks="int(status = 'FAILED')",
            input_bytes=metric("input_bytes"), shuffle_read_bytes=READ_BYTES, last_ms="finish_ms",
        ))
        .unionByName(_records(samples, **keys, total_heap="heap_used", samples="int(heap_used IS NOT NULL)", max_heap="heap_used", last_ms="ts_ms"))
        .unionByName(_records(ends, app_id="app_id", end_ms="end_ms", last_ms="end_ms"))
    )


def leaving_executors(
    records: DataFrame, state_path: str, out_path: str, checkpoint: str, lateness_ms: int = LATENESS_MS,
    keep_ms: int = KEEP_MS, every: str | None = None,
) -> StreamingQuery:
    """The roll-up of each executor, once: when it was removed or, if still there, when its application ended.

    It is made when the newest time told is ``lateness_ms`` past that; what comes later is not counted.  An executor that
    was never added makes no row.  The carried table has a row per executor that is there or was reported in the last
    ``keep_ms``.  Running attempts count when they end.
    """
    table = BatchTable(state_path, ROWS)
    columns = [part.split()[0] for part in ROWS.split(", ")]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        seen = table.before(batch.sparkSession, batch_id).unionByName(batch)
        ends = seen.filter("end_ms IS NOT NULL").groupBy("app_id").agg(F.max("end_ms").alias("app_end"))
        whole = seen.groupBy(*EXECUTOR_KEYS).agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.max(c).alias(c) for c in _HIGHEST])
        newest = seen.agg(F.max("last_ms")).first()[0] or 0
        at = "coalesce(removed_ms, app_end)"
        judged = whole.join(ends, "app_id", "left").selectExpr(
            *[c for c in columns if c not in ("reported", "end_ms")], "coalesce(app_end, end_ms) AS end_ms", "reported", f"{at} AS eval_ms",
            f"NOT reported AND added_ms IS NOT NULL AND coalesce({at} + {lateness_ms} <= {newest}L, false) AS due",
            f"(reported OR executor_id IS NULL) AND coalesce({newest}L - last_ms > {keep_ms}, false) AS gone",
        ).persist()
        append_batch(
            judged.filter("due").selectExpr(
                *EXECUTOR_KEYS, "host", "eval_ms - added_ms AS elapsed_ms", "eval_ms", *_SUMS[:4],
                "coalesce(total_heap div nullif(samples, 0), 0L) AS avg_heap", "coalesce(max_heap, 0L) AS max_heap",
            ), out_path, batch_id,
        )
        table.write(judged.filter("NOT gone").withColumn("reported", F.col("reported") | F.col("due")).select(*columns), batch_id)
        judged.unpersist()

    return run(records, on_batch, checkpoint, every=every)
