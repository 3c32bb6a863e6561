"""Failed task attempts: the event, its likely cause, and the out-of-memory report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.failures import failure_advice_sql, is_oom_sql
from ..functions.formats import fmt_bytes_sql
from ..functions.text import message_sql
from ..schemas import STAGE_KEYS
from ..settings import RULE_ORDER, Thresholds
from .rules import skew_flag
from .tasks import failed_attempts

# Event names, default memory, message templates.
TASK_FAILED = "TASK_FAILED"
TASK_DIAGNOSIS = "TASK_DIAGNOSIS"
DEFAULT_MEMORY = 1073741824
EVENT_TEXT = "task {stage_id}.{task_id} failed, reason: {failure_reason}, running on executor {executor_id}"
CAUSE_TEXT = "task {task_id} failed: {failure_reason} {advice}"
OOM_TEXT = (
    "executor {executor_id} failed due to OOM, possible reasons: "
    "1) data skew 2)executor memory too low 3)reading too large data\n{lines}"
)
MEMORY_LINE = "current executor memory: {size}"
INPUT_LINE = "stage_{stage_id} input data: {size}"
READ_LINE = "stage_{stage_id} shuffle read data: {size}"

REASON = "coalesce(failure_reason, '')"
IS_OOM = is_oom_sql(REASON)


def _alert_columns(event: str, rule: str, message: str) -> list[str]:
    return [
        f"'{event}' AS event", "'ERROR' AS level", f"'{rule}' AS rule", "task_id", "executor_id",
        "finish_ms AS eval_ms", f"{RULE_ORDER[rule]} AS rule_ord", f"{message} AS message",
    ]


EVENT = _alert_columns(TASK_FAILED, "task_failed", message_sql(EVENT_TEXT))
CAUSE = _alert_columns(
    TASK_DIAGNOSIS, "task_failure_cause", message_sql(CAUSE_TEXT, advice=failure_advice_sql(REASON))
)


def oom_attempts(tasks: DataFrame) -> DataFrame:
    """Failed attempts whose text shows that the container ran out of memory."""
    return failed_attempts(tasks).filter(IS_OOM)


def failure_events(tasks: DataFrame) -> DataFrame:
    """One TASK_FAILED event per attempt that ended without success."""
    return failed_attempts(tasks).selectExpr(*STAGE_KEYS, *EVENT)


def failure_causes(tasks: DataFrame) -> DataFrame:
    """Failure text with advice, for every failure that is not the out-of-memory kind."""
    return failed_attempts(tasks).filter(f"NOT {IS_OOM}").selectExpr(*STAGE_KEYS, *CAUSE)


def failure_alerts(tasks: DataFrame) -> DataFrame:
    """Events and causes in one pass over the failed attempts."""
    event, cause = f"struct({', '.join(EVENT)})", f"struct({', '.join(CAUSE)})"
    return failed_attempts(tasks).selectExpr(
        *STAGE_KEYS, f"inline(array_compact(array({event}, if({IS_OOM}, NULL, {cause}))))"
    )


def stage_context(described: DataFrame, app_configs: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Per stage: bytes read, skew flag, executor memory.  ``described`` as from :func:`rules.describe`."""
    known = described.selectExpr(
        *STAGE_KEYS, "input_bytes", "shuffle_read_bytes", f"{skew_flag(th)} AS skew_flag"
    ).join(app_configs.select("app_id", "executor_memory"), "app_id", "left")
    return known.withColumn("executor_memory", F.expr(f"coalesce(executor_memory, {DEFAULT_MEMORY}L)"))


def failure_context(tasks: DataFrame, context: DataFrame) -> DataFrame:
    """Failed attempts with the context of their stage.

    The context is put together per stage first, so the failures are joined once and each finds one
    row.  A stage with a large share of all failures is split by Spark's skew join, since nothing
    after this join needs its partitioning.  Whether the context is small enough to broadcast is left
    to the size statistics.
    """
    failed = failed_attempts(tasks).select(*STAGE_KEYS, "task_id", "executor_id", "finish_ms", "failure_reason")
    known = failed.join(context, STAGE_KEYS, "left")
    return known.withColumn("executor_memory", F.expr(f"coalesce(executor_memory, {DEFAULT_MEMORY}L)"))


def oom_reports(context: DataFrame) -> DataFrame:
    """Out-of-memory report: memory setting, data of the stage where there was any, skew if flagged."""
    def data(template: str, column: str) -> str:
        return f"if({column} > 0, {message_sql(template, size=fmt_bytes_sql(column))}, NULL)"

    lines = [
        message_sql(MEMORY_LINE, size=fmt_bytes_sql("executor_memory")),
        data(INPUT_LINE, "input_bytes"), data(READ_LINE, "shuffle_read_bytes"), "skew_flag",
    ]
    message = message_sql(OOM_TEXT, lines=f"concat_ws('\\n', {', '.join(lines)})")
    return context.filter(IS_OOM).selectExpr(*STAGE_KEYS, *_alert_columns(TASK_DIAGNOSIS, "oom_report", message))
