"""Canonical telemetry tables, as DDL strings.

All clocks are epoch milliseconds (``bigint``), so no result depends on the session time zone.
"""

APPLICATIONS = (
    "app_id string, app_name string, user string, queue string, "
    "submit_ms bigint, start_ms bigint, end_ms bigint"
)
APP_CONF = "app_id string, key string, value string"
EXECUTORS = (
    "app_id string, executor_id string, host string, cores int, added_ms bigint, removed_ms bigint"
)
STAGES = (
    "app_id string, stage_id int, stage_attempt_id int, name string, num_tasks bigint, "
    "parent_ids array<int>, submission_ms bigint, completion_ms bigint, failure_reason string"
)
STAGE_RDDS = (
    "app_id string, stage_id int, stage_attempt_id int, rdd_id bigint, "
    "parent_ids array<bigint>, callsite string"
)
TASK_ATTEMPTS = (
    "app_id string, stage_id int, stage_attempt_id int, task_id bigint, executor_id string, "
    "host string, status string, launch_ms bigint, finish_ms bigint, duration_ms bigint, "
    "run_ms bigint, deserialize_ms bigint, result_ser_ms bigint, getting_result_ms bigint, "
    "gc_ms bigint, input_bytes bigint, input_records bigint, output_bytes bigint, "
    "shuffle_local_bytes bigint, shuffle_remote_bytes bigint, shuffle_read_records bigint, "
    "shuffle_write_bytes bigint, shuffle_write_records bigint, failure_reason string"
)
EXECUTOR_SAMPLES = "app_id string, executor_id string, ts_ms bigint, heap_used bigint, raw string"
EXECUTOR_POLLS = "app_id string, executor_id string, ts_ms bigint, ok boolean"
HOST_SAMPLES = (
    "metric string, instance string, nodename string, mode string, cpu string, "
    "ts_ms bigint, value double"
)
DIAGNOSTICS = (
    "app_id string, event string, level string, rule string, stage_id int, stage_attempt_id int, "
    "task_id bigint, executor_id string, eval_ms bigint, rule_ord int, message string"
)

STAGE_KEYS = ["app_id", "stage_id", "stage_attempt_id"]
EXECUTOR_KEYS = ["app_id", "executor_id"]
