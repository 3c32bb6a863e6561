"""Projections and filters over task attempts.

Evaluation times are epoch milliseconds, or a SQL expression over the task columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import time_sql
from ..schemas import STAGE_KEYS
from ..settings import Thresholds


def metric(name: str) -> str:
    """SQL of a task metric; a metric that was never reported counts as 0."""
    return f"coalesce({name}, 0L)"


READ_BYTES = f"({metric('shuffle_local_bytes')} + {metric('shuffle_remote_bytes')})"
# Part of the duration spent neither computing nor moving the task and its result; not below 0.
DELAY = "greatest(0L, {} - {} - {} - {} - {})".format(
    *map(metric, ["duration_ms", "run_ms", "deserialize_ms", "result_ser_ms", "getting_result_ms"])
)
# Whether an attempt counts for the input distribution: successful, or old and not failed.
INPUT_ELIGIBLE = "(status = 'SUCCESS' OR (status <> 'FAILED' AND {time} > {old}))"
# Whether the GC rule looks at an attempt.
GC_CANDIDATE = "(coalesce(gc_ms, 0L) > {floor} AND {time} > {old})"


def effective_time(eval_ms: int | str) -> str:
    """SQL of the running time so far of a running attempt, else its duration."""
    return f"if(status = 'RUNNING', {time_sql(eval_ms)} - launch_ms, {metric('duration_ms')})"


def with_time(tasks: DataFrame, eval_ms: int | str) -> DataFrame:
    return tasks.withColumn("time_ms", F.expr(effective_time(eval_ms)))


def input_eligible(time: str = "time_ms", th: Thresholds = Thresholds()) -> Column:
    return F.expr(INPUT_ELIGIBLE.format(time=time, old=th.old_task_ms))


def gc_candidate(time: str = "time_ms", th: Thresholds = Thresholds()) -> Column:
    return F.expr(GC_CANDIDATE.format(time=time, old=th.old_task_ms, floor=th.gc_floor_ms))


def snapshot_at(tasks: DataFrame, at_ms: int | str) -> DataFrame:
    """The attempts as they stood at ``at_ms``: launched by then, still running if they ended later."""
    at = time_sql(at_ms)
    ended = f"(finish_ms IS NOT NULL AND finish_ms <= {at})"
    then = {"status": f"if({ended}, status, 'RUNNING')"}
    then |= {c: f"if({ended}, {c}, NULL)" for c in ("finish_ms", "duration_ms", "failure_reason")}
    return tasks.filter(f"launch_ms <= {at}").selectExpr(
        *[f"{then[c]} AS {c}" if c in then else c for c in tasks.columns]
    )


def task_list(tasks: DataFrame, eval_ms: int | str, stage: Column | str | None = None) -> DataFrame:
    """All attempts, longest running time first within each stage; ``stage`` picks some stages."""
    chosen = tasks if stage is None else tasks.filter(stage)
    return with_time(chosen, eval_ms).orderBy(*STAGE_KEYS, F.desc("time_ms"), "task_id")


def top_tasks(tasks: DataFrame, eval_ms: int | str, k: int) -> DataFrame:
    """The ``k`` longest attempts of each stage.  Spark keeps only k rows per stage before the shuffle."""
    order = Window.partitionBy(*STAGE_KEYS).orderBy(F.desc("time_ms"), "task_id")
    ranked = with_time(tasks, eval_ms).withColumn("position", F.row_number().over(order))
    return ranked.filter(F.col("position") <= k)


def failed_attempts(tasks: DataFrame) -> DataFrame:
    """Attempts that ended without success; killed ones count too."""
    return tasks.filter("status IN ('FAILED', 'KILLED')")
