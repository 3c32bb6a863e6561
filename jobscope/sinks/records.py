"""Output records of every kind in one shape.

A record is ``(app_id, event, level, eval_ms, text, body, points)``: the console text without time
and level, the JSON body (null for diagnoses) and the Graphite points as ``<name> <value>``.  All of
it is projection; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.formats import fmt_bytes_sql, fmt_duration_sql
from ..functions.text import literal, message_sql
from ..operators.tasks import failed_attempts

# Event names, console templates, point prefixes.
APP_START = "APP_START"
APP_END = "APP_END"
STAGE_COMPLETED = "STAGE_COMPLETED"
EXECUTOR_REMOVED = "EXECUTOR_REMOVED"
TASK_FAILED = "TASK_FAILED"
TEXTS = {
    APP_START: "appId: {app_id}, configuration: {settings}",
    APP_END: (
        "{app_id} end, elapsed time: {elapsed} memorySeconds: {memory_seconds}, vCoreSeconds: {vcore_seconds}"
    ),
    STAGE_COMPLETED: (
        "stage {stage_id} complete, time: {elapsed}, totalTask: {num_tasks}, input: {input}, output: {output}, "
        "shuffleRead: {shuffle_read}, shuffleWrite: {shuffle_write}"
    ),
    TASK_FAILED: "task {stage_id}.{task_id} failed, reason: {failure_reason}, running on executor {executor_id}",
    EXECUTOR_REMOVED: (
        "executor_{executor_id}, host: {host}, completedTasks: {completed_tasks}, failedTask: {failed_tasks}, "
        "inputBytes: {input}, shuffleReadBytes: {shuffle_read}, "
        "average heap memory: {mean_heap}, max heap memory: {top_heap}"
    ),
}
PREFIXES = {
    APP_START: "{app_id}_APP_START",
    APP_END: "{app_id}_APP_END",
    STAGE_COMPLETED: "{app_id}_STAGE_COMPLETED_stage{stage_id}",
    TASK_FAILED: "{app_id}_TASK_FAILED_stage{stage_id}_{task_id}",
    EXECUTOR_REMOVED: "{app_id}_EXECUTOR_REMOVED_executor{executor_id}",
}


def _records(
    df: DataFrame, event: str, level: str, eval_ms: str, fields: dict[str, str], points: list[str], **parts: str
) -> DataFrame:
    """``fields`` (name to SQL) are the JSON body in order; ``points`` names the Graphite points."""
    body = ", ".join(f"{sql} AS {name}" for name, sql in {"appId": "app_id", **fields}.items())
    prefix = message_sql(PREFIXES[event])
    lines = [f"concat({prefix}, {literal(f'_{name} ')}, coalesce(string({fields[name]}), ''))" for name in points]
    return df.selectExpr(
        "app_id", f"'{event}' AS event", f"'{level}' AS level", f"bigint({eval_ms}) AS eval_ms",
        f"{message_sql(TEXTS[event], **parts)} AS text", f"to_json(struct({body})) AS body",
        f"array({', '.join(lines)}) AS points",
    )


def app_start_records(summary: DataFrame) -> DataFrame:
    # Field names; settings with "memory" in their name are shown in byte units.
    settings = {
        "driverMemory": "driver_memory", "executorMemory": "executor_memory", "executorCores": "executor_cores",
        "shufflePartitions": "shuffle_partitions", "maxDynamicExecutors": "max_dynamic_executors",
        "executorInstances": "executor_instances",
    }
    shown = ", ".join(
        f"concat('{k}: ', {fmt_bytes_sql(c) if 'memory' in k.lower() else c})" for k, c in settings.items()
    )
    configuration = ", ".join(f"{c} AS {k}" for k, c in settings.items())
    fields = {
        "submitTime": "submit_ms", "startTime": "start_ms", "user": "`user`", "queue": "queue",
        "configuration": f"struct({configuration})",
    }
    points = ["submitTime", "startTime", "user", "queue"]
    return _records(
        summary, APP_START, "INFO", "start_ms", fields, points, settings=f"concat_ws(', ', {shown})"
    )


def app_end_records(summary: DataFrame) -> DataFrame:
    fields = {"elapseTime": "elapsed_ms", "memorySeconds": "memory_seconds", "vCoreSeconds": "vcore_seconds"}
    return _records(
        summary, APP_END, "INFO", "end_ms", fields, list(fields), elapsed=fmt_duration_sql("elapsed_ms")
    )


def stage_records(summary: DataFrame) -> DataFrame:
    fields = {
        "elapseTime": "elapsed_ms", "stageId": "stage_id", "totalTask": "num_tasks", "inputBytes": "input_bytes",
        "outputBytes": "output_bytes", "shuffleReadBytes": "shuffle_read_bytes",
        "shuffleWriteBytes": "shuffle_write_bytes",
    }
    points = ["totalTask", "inputBytes", "outputBytes", "shuffleReadBytes", "shuffleWriteBytes"]
    sizes = {m: fmt_bytes_sql(f"{m}_bytes") for m in ("input", "output", "shuffle_read", "shuffle_write")}
    return _records(
        summary, STAGE_COMPLETED, "INFO", "eval_ms", fields, points, elapsed=fmt_duration_sql("elapsed_ms"), **sizes
    )


def failure_records(tasks: DataFrame) -> DataFrame:
    fields = {
        "stageId": "stage_id", "taskId": "task_id", "executorId": "executor_id",
        "failedReason": "coalesce(failure_reason, '')",
    }
    failed = failed_attempts(tasks)
    return _records(failed, TASK_FAILED, "ERROR", "finish_ms", fields, ["executorId", "failedReason"])


def executor_records(rollup: DataFrame) -> DataFrame:
    fields = {
        "executorId": "executor_id", "host": "host", "elapseTime": "elapsed_ms", "completedTasks": "completed_tasks",
        "failedTask": "failed_tasks", "inputBytes": "input_bytes", "shuffleReadBytes": "shuffle_read_bytes",
        "averageHeapMemory": "avg_heap", "maxHeapMemory": "max_heap",
    }
    sizes = {
        "input": "input_bytes", "shuffle_read": "shuffle_read_bytes", "mean_heap": "avg_heap", "top_heap": "max_heap",
    }
    points = [name for name in fields if name != "executorId"]
    return _records(
        rollup, EXECUTOR_REMOVED, "INFO", "eval_ms", fields, points,
        **{name: fmt_bytes_sql(column) for name, column in sizes.items()},
    )


def diagnosis_records(diagnostics: DataFrame) -> DataFrame:
    """Diagnoses have a console text only."""
    return diagnostics.filter(f"event <> '{TASK_FAILED}'").selectExpr(
        "app_id", "event", "level", "eval_ms", "message AS text", "string(NULL) AS body",
        "cast(array() AS array<string>) AS points",
    )
