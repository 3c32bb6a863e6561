"""What a stage is about to read, told at its submission, from one carried row per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import shuffle_read_notices
from ..operators.tasks import metric
from ..schemas import STAGE_KEYS
from .state import BatchTable, append_batch, run

# Fixed value: how late a row about a parent may be before the notice is made.
LATENESS_MS = 600_000
# How long the stages of an ended application are remembered.
KEEP_MS = 6 * 3_600_000

_SUBMISSION = ["name", "num_tasks", "parent_ids", "submission_ms"]
ROWS = (
    "app_id string, stage_id int, stage_attempt_id int, name string, num_tasks bigint, parent_ids array<int>, submission_ms bigint, "
    "shuffle_write_bytes bigint, noticed boolean, end_ms bigint, last_ms bigint"
)


def _records(df: DataFrame, **given: str) -> DataFrame:
    empty = {"shuffle_write_bytes": "0L", "noticed": "false"}
    columns = [part.split() for part in ROWS.split(", ")]
    return df.selectExpr(*[f"CAST({given.get(n, empty.get(n, 'NULL'))} AS {kind}) AS {n}" for n, kind in columns])


def notice_records(stages: DataFrame, updates: DataFrame, ends: DataFrame) -> DataFrame:
    """One stream of what notices need: submitted stages, bytes written by ended attempts, ends of applications."""
    keys = {k: k for k in STAGE_KEYS}
    return (
        _records(stages.filter("submission_ms IS NOT NULL"), **keys, **{c: c for c in _SUBMISSION}, last_ms="submission_ms")
        .unionByName(_records(
            updates.filter("status <> 'RUNNING'"), **keys, last_ms="finish_ms",
            shuffle_write_bytes=f"if(status <> 'FAILED', {metric('shuffle_write_bytes')}, 0L)",
        ))
        .unionByName(_records(ends, app_id="app_id", end_ms="end_ms", last_ms="end_ms"))
    )


def read_notices(
    records: DataFrame, state_path: str, out_path: str, checkpoint: str, lateness_ms: int = LATENESS_MS,
    keep_ms: int = KEEP_MS, every: str | None = None,
) -> StreamingQuery:
    """The notice of each submitted stage attempt, once, by the clock of the telemetry.

    A submission is judged when the newest time told is ``lateness_ms`` past it, whatever the order of arrival.  All bytes
    of ended attempts told by then count; a parent attempt that is told later changes nothing.  A submission told again
    makes no second notice.  Stages leave the carried table ``keep_ms`` after their application ended.
    """
    table = BatchTable(state_path, ROWS)
    columns = [part.split()[0] for part in ROWS.split(", ")]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        seen = table.before(batch.sparkSession, batch_id).unionByName(batch)
        newest = seen.agg(F.max("last_ms")).first()[0] or 0
        ends = seen.filter("end_ms IS NOT NULL").groupBy("app_id").agg(F.max("end_ms").alias("app_end"))
        whole = seen.groupBy(*STAGE_KEYS).agg(
            F.sum("shuffle_write_bytes").alias("shuffle_write_bytes"), *[F.max(c).alias(c) for c in [*_SUBMISSION, "noticed", "end_ms", "last_ms"]]
        )
        judged = whole.join(ends, "app_id", "left").selectExpr(
            *columns, f"NOT noticed AND coalesce(submission_ms + {lateness_ms} <= {newest}L, false) AS due",
            f"coalesce({newest}L - app_end > {keep_ms}, false) AS gone",
        ).persist()
        stages = judged.filter("stage_id IS NOT NULL")
        append_batch(shuffle_read_notices(stages.filter("due"), stages), out_path, batch_id)
        table.write(judged.filter("NOT gone").withColumn("noticed", F.col("noticed") | F.col("due")).select(*columns), batch_id)
        judged.unpersist()

    return run(records, on_batch, checkpoint, every=every)
