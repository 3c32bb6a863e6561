"""One Spark query per operator, each over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.functions import (
    executor_id_from_path,
    failure_advice,
    failure_class,
    failure_text,
    fmt_bytes,
    fmt_duration,
    parse_size,
)
from jobscope.functions.failures import TASK_END_REASON
from jobscope.operators import (
    applications,
    executors,
    failures,
    hosts,
    lineage,
    rules,
    stages,
    tasks,
    throttle,
)
from jobscope.plans import Telemetry, diagnose, event_records
from jobscope.schemas import STAGE_KEYS
from jobscope.session import materialise, scratch_path
from jobscope.sinks import (
    console_lines,
    diagnosis_records,
    event_json,
    graphite_lines,
    route,
    write_executor_samples,
)
from jobscope.sources import (
    parse_event_log,
    parse_executor_samples,
    parse_prometheus,
    read_executor_samples,
)
from jobscope.streaming import executor_state, host_state, monitors, notices, stage_state
from jobscope.streaming.state import BatchTable

from .fixtures import EVAL_MS, HALF_MS, Tables, base_table, sql_over

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TASK_KEY = ["app_id", "stage_id", "task_id"]
ALERT = [
    "app_id", "event", "level", "rule", "stage_id", "stage_attempt_id", "task_id", "executor_id",
    "eval_ms", "rule_ord", "message",
]
# Periods of the throttle queries: with the default ones hardly an alert would be left.
# Counters whose last alert is older than this, on the clock of the events, have left.
EXPIRY_MS = 60_000
PERIODS = dict.fromkeys(["long_tail", "skew", "gc", "host", "heap"], 3)


def over_tables(name: str):
    """Registers a query that is a function of the telemetry tables."""
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Tables.of(spark, sf_dir))
        return build

    return register


def _stats(t: Tables) -> DataFrame:
    return stages.stage_stats(t.tasks, EVAL_MS)


def _plain_stats(t: Tables) -> DataFrame:
    return stages.plain_stats(t.tasks, EVAL_MS)


def _telemetry(t: Tables) -> Telemetry:
    return Telemetry(
        tasks=t.tasks, stages=t.stages_with_parents, app_conf=t.conf, rdds=t.rdds, samples=t.samples,
        polls=t.polls, host_samples=t.host_clock, host_names=t.host_names, executors=t.executors,
        applications=t.apps,
    )


def _diagnose(t: Tables) -> DataFrame:
    return diagnose(_telemetry(t), EVAL_MS)


# --- sources ---------------------------------------------------------------------------------


def _end_reason() -> Column:
    """The end reason record that has the failure text of an attempt."""
    text, task = F.col("failure_reason"), F.col("task_id")
    lost = text.startswith("ExecutorLostFailure")
    blamed = text.contains("caused by one of the running tasks")
    return F.struct(
        F.when(text.isNull(), "Success").when(text.startswith("TaskKilled"), "TaskKilled")
        .when(lost, "ExecutorLostFailure").otherwise("ExceptionFailure").alias("Reason"),
        F.when(~lost & ~text.startswith("TaskKilled"), text).alias("Full Stack Trace"),
        F.when(text.startswith("TaskKilled"), "another attempt succeeded").alias("Kill Reason"),
        F.when(lost, (task % 12).cast("string")).alias("Executor ID"),
        F.when(lost, blamed).alias("Exit Caused By App"),
        F.when(lost, F.regexp_extract(text, r"Reason: (.*)$", 1)).alias("Loss Reason"),
    )


def _event_lines(tasks_df: DataFrame) -> DataFrame:
    """Task records as the lines of an event log."""
    status = F.col("status")
    info = F.struct(
        F.col("task_id").alias("Task ID"), F.col("launch_ms").alias("Launch Time"),
        F.col("finish_ms").alias("Finish Time"), F.lit(0).alias("Getting Result Time"),
        F.col("executor_id").alias("Executor ID"), F.col("host").alias("Host"),
        (status == "FAILED").alias("Failed"), (status == "KILLED").alias("Killed"),
    )
    metrics = F.struct(
        F.col("run_ms").alias("Executor Run Time"), F.col("deserialize_ms").alias("Executor Deserialize Time"),
        F.col("result_ser_ms").alias("Result Serialization Time"), F.col("gc_ms").alias("JVM GC Time"),
        F.struct(
            F.col("shuffle_remote_bytes").alias("Remote Bytes Read"),
            F.col("shuffle_local_bytes").alias("Local Bytes Read"),
            F.col("shuffle_read_records").alias("Total Records Read"),
        ).alias("Shuffle Read Metrics"),
        F.struct(
            F.col("shuffle_write_bytes").alias("Shuffle Bytes Written"),
            F.col("shuffle_write_records").alias("Shuffle Records Written"),
        ).alias("Shuffle Write Metrics"),
        F.struct(F.col("input_bytes").alias("Bytes Read"), F.col("input_records").alias("Records Read"))
        .alias("Input Metrics"),
        F.struct(F.col("output_bytes").alias("Bytes Written")).alias("Output Metrics"),
    )
    stage = [F.col("stage_id").alias("Stage ID"), F.col("stage_attempt_id").alias("Stage Attempt ID")]
    start = F.to_json(F.struct(F.lit("SparkListenerTaskStart").alias("Event"), *stage, info.alias("Task Info")))
    end = F.to_json(F.struct(
        F.lit("SparkListenerTaskEnd").alias("Event"), *stage, _end_reason().alias("Task End Reason"),
        info.alias("Task Info"), metrics.alias("Task Metrics"),
    ))
    lines = F.array_compact(F.array(start, F.when(status != "RUNNING", end)))
    return tasks_df.select("app_id", F.explode(lines).alias("value"))


def _log_lines(t: Tables) -> DataFrame:
    """The telemetry tables as the lines of event logs."""
    def lines(df: DataFrame, kind: str, *fields: Column) -> DataFrame:
        return df.select("app_id", F.to_json(F.struct(F.lit(f"SparkListener{kind}").alias("Event"), *fields)).alias("value"))

    def at(ms: str) -> Column:
        return F.col(ms).alias("Timestamp")

    properties = F.map_from_entries(F.array_append(
        F.collect_list(F.struct("key", "value")), F.struct(F.lit("spark.yarn.queue").alias("key"), F.lit("default").alias("value"))
    ))
    conf = t.conf.groupBy("app_id").agg(properties.alias("Spark Properties"))
    executor = F.col("executor_id").alias("Executor ID")
    rdd = F.struct(F.col("rdd_id").alias("RDD ID"), F.col("callsite").alias("Callsite"), F.col("parent_ids").alias("Parent IDs"))
    rdds = t.rdds.groupBy(*STAGE_KEYS).agg(F.collect_list(rdd).alias("rdds"))
    told = t.stages_with_parents.join(rdds, STAGE_KEYS, "left")
    info = [
        F.col("stage_id").alias("Stage ID"), F.col("stage_attempt_id").alias("Stage Attempt ID"), F.col("name").alias("Stage Name"),
        F.col("num_tasks").alias("Number of Tasks"), F.col("parent_ids").alias("Parent IDs"), F.col("submission_ms").alias("Submission Time"),
    ]
    done = [F.col("completion_ms").alias("Completion Time"), F.col("failure_reason").alias("Failure Reason")]
    return stages.union_all(
        lines(t.apps, "ApplicationStart", F.col("app_name").alias("App Name"), F.col("user").alias("User"), at("start_ms")),
        lines(t.apps.withColumn("end", F.lit(EVAL_MS)), "ApplicationEnd", at("end")),
        lines(conf, "EnvironmentUpdate", F.col("Spark Properties")),
        lines(t.executors, "ExecutorAdded", at("added_ms"), executor, F.struct(F.col("host").alias("Host"), F.col("cores").alias("Total Cores")).alias("Executor Info")),
        lines(t.executors.filter("removed_ms IS NOT NULL"), "ExecutorRemoved", at("removed_ms"), executor),
        lines(told, "StageSubmitted", F.struct(*info, F.coalesce("rdds", F.array()).alias("RDD Info")).alias("Stage Info")),
        lines(told.filter("completion_ms IS NOT NULL"), "StageCompleted", F.struct(*info, *done, F.array().cast("array<int>").alias("RDD Info")).alias("Stage Info")),
        lines(t.apps, "JobStart", F.lit(0).alias("Job ID")),
        _event_lines(t.tasks),
    )


def _log_table(name: str, table: str, *columns: str) -> None:
    """A table of the event log; lists are given as text, in order, for the order of a list is not fixed."""
    @over_tables(name)
    def _(t):
        return parse_event_log(_log_lines(t))[table].selectExpr(*(columns or ["*"]))


_PARENTS = "array_join(array_sort(parent_ids), ',') AS parent_ids"
_log_table("src_event_log", "task_attempts")
_log_table("src_event_log_applications", "applications")
_log_table("src_event_log_conf", "app_conf")
_log_table("src_event_log_executors", "executors")
_log_table("src_event_log_stages", "stages", *STAGE_KEYS, "name", "num_tasks", _PARENTS, "submission_ms", "completion_ms", "failure_reason")
_log_table("src_event_log_rdds", "stage_rdds", *STAGE_KEYS, "rdd_id", _PARENTS, "callsite")


@over_tables("src_task_list")
def _(t):
    return tasks.task_list(t.tasks, EVAL_MS).select(*STAGE_KEYS, "task_id", "status", "time_ms")


@over_tables("src_executor_inventory")
def _(t):
    return executors.executor_inventory(t.executors)


@over_tables("src_executor_samples")
def _(t):
    path = F.concat(F.lit("/samples/"), F.col("app_id"), F.lit("/executor_"), F.col("executor_id"), F.lit("/metrics"))
    line = F.to_json(F.struct(F.col("ts_ms").alias("epochMillis"), F.col("heap_used").cast("double").alias("heapMemoryTotalUsed")))
    lines = t.samples.select(path.alias("path"), line.alias("value"))
    return parse_executor_samples(lines).drop("raw")


@over_tables("src_host_samples")
def _(t):
    second = F.col("ts_ms") / 1000
    labels = F.map_filter(
        F.create_map(
            F.lit("__name__"), F.col("metric"), F.lit("instance"), F.col("instance"),
            F.lit("mode"), F.col("mode"), F.lit("cpu"), F.col("cpu"),
        ),
        lambda _, v: v.isNotNull(),
    )
    result = F.array(F.struct(labels.alias("metric"), F.array(second.cast("string"), F.col("value").cast("string")).alias("value")))
    document = F.to_json(F.struct(
        F.when(second.cast("bigint") % 10 == 9, "error").otherwise("success").alias("status"),
        F.struct(result.alias("result")).alias("data"),
    ))
    found = parse_prometheus(t.host_samples.select(document.alias("value")))
    return found.select("metric", "instance", "mode", "cpu", "ts_ms", F.round("value", 6).alias("value"))


@over_tables("src_app_conf")
def _(t):
    return applications.app_configs(t.conf)


# --- sinks -----------------------------------------------------------------------------------


def _records(t: Tables) -> DataFrame:
    return event_records(_telemetry(t), EVAL_MS).unionByName(diagnosis_records(_diagnose(t)))


@over_tables("sink_console_lines")
def _(t):
    return console_lines(_records(t))


@over_tables("sink_event_json")
def _(t):
    return event_json(_records(t))


@over_tables("sink_graphite_lines")
def _(t):
    return graphite_lines(event_records(_telemetry(t), EVAL_MS), EVAL_MS // 1000)


@over_tables("sink_executor_samples")
def _(t):
    root = scratch_path(t.spark, "samples")
    write_executor_samples(t.samples, root)
    return read_executor_samples(t.spark, root).drop("raw")


@over_tables("sink_route")
def _(t):
    return route(_records(t), "metaServer", "events", EVAL_MS // 1000)


# --- projections, filters, predicates --------------------------------------------------------


@over_tables("task_effective_time")
def _(t):
    return tasks.with_time(t.tasks, EVAL_MS).select(*TASK_KEY, "time_ms")


@over_tables("task_input_eligible")
def _(t):
    timed = tasks.with_time(t.tasks, EVAL_MS)
    return timed.select(*TASK_KEY, tasks.input_eligible().alias("eligible"))


@over_tables("stage_bytes_nonfailed")
def _(t):
    return stages.stage_bytes(t.tasks)


@over_tables("gate_running_only")
def _(t):
    described = rules.describe(_stats(t), t.stages)
    alerts = rules.task_alerts(described, EVAL_MS, only_running=True)
    return alerts.select("app_id", "stage_id", "rule", "task_id", "message")


@over_tables("gate_half_finished")
def _(t):
    finished = stages.finished_counts(tasks.snapshot_at(t.tasks, HALF_MS))
    return stages.half_finished(t.stages, finished).select("app_id", "stage_id", "num_tasks", "n_finished")


@over_tables("task_snapshot_at")
def _(t):
    return tasks.snapshot_at(t.tasks, HALF_MS).select(
        *TASK_KEY, "status", "finish_ms", "duration_ms", "failure_reason"
    )


@over_tables("gc_candidate")
def _(t):
    timed = tasks.with_time(t.tasks, EVAL_MS)
    return timed.filter(tasks.gc_candidate()).select(*TASK_KEY, "gc_ms", "time_ms")


@over_tables("failed_attempts")
def _(t):
    return tasks.failed_attempts(t.tasks).select(*TASK_KEY, "status", "failure_reason")


# --- joins -----------------------------------------------------------------------------------


@over_tables("stage_parent_shuffle")
def _(t):
    found = stages.parent_shuffle(t.stages_with_parents, stages.stage_bytes(t.tasks))
    return found.select("app_id", "stage_id", "num_tasks", "parent_shuffle_bytes")


def _described(t: Tables) -> DataFrame:
    return rules.describe(_stats(t), t.stages, lineage.stage_callsites(t.rdds))


def _context(t: Tables) -> DataFrame:
    known = failures.stage_context(_described(t), applications.app_configs(t.conf))
    return failures.failure_context(t.tasks, known)


@over_tables("failure_stage_context")
def _(t):
    return _context(t)


@over_tables("executor_heap_join")
def _(t):
    return executors.with_heap(executors.executor_inventory(t.executors), t.samples)


def _hosts(t: Tables) -> DataFrame:
    return t.executors.select("host").distinct()


@over_tables("host_instance_resolve")
def _(t):
    return hosts.resolve_hosts(_hosts(t), t.host_names)


def _stragglers(t: Tables) -> DataFrame:
    return materialise(rules.unexplained_stragglers(_stats(t), EVAL_MS), "stragglers")


@over_tables("straggler_host_asof")
def _(t):
    # The evaluations are spread over the time the host samples span, one stage after the other.
    step = sql_over(t.spark, "SELECT CAST(floor(max(event_id) * 1000 / 48) AS BIGINT) AS step FROM events", t.base)
    stragglers = _stragglers(t).withColumn(
        "eval_ms", F.lit(EVAL_MS) - (47 - F.col("stage_id")) * step.scalar()
    )
    state = hosts.host_state_asof(stragglers, t.host_names, t.host_clock)
    return stragglers.join(state, ["host", "eval_ms"]).drop("stage_attempt_id")


@over_tables("skew_with_callsite")
def _(t):
    described = materialise(_described(t), "stage-stats")
    both = [rules.one_rule(described, r, EVAL_MS) for r in ("shuffle_read_skew", "shuffle_write_skew")]
    return stages.union_all(*both).select("app_id", "stage_id", "rule", "task_id", "message")


# --- aggregations ----------------------------------------------------------------------------


@over_tables("stage_task_distribution")
def _(t):
    return stages.task_distribution(_stats(t))


@over_tables("stage_argmax_tasks")
def _(t):
    return stages.argmax_tasks(_plain_stats(t))


@over_tables("stage_five_numbers")
def _(t):
    return stages.five_numbers(_stats(t))


@over_tables("stage_running_bytes")
def _(t):
    return stages.running_bytes(_plain_stats(t))


@over_tables("executor_heap_stats")
def _(t):
    return executors.heap_stats(t.samples)


@over_tables("executor_rollup")
def _(t):
    return executors.executor_rollup(t.executors, t.tasks, t.samples, EVAL_MS)


@over_tables("stage_summary")
def _(t):
    return stages.stage_summary(t.stages, t.tasks)


@over_tables("app_summary")
def _(t):
    return applications.app_summary(t.apps, applications.app_configs(t.conf), t.executors, EVAL_MS)


@over_tables("stage_finished_count")
def _(t):
    return stages.finished_counts(t.tasks)


# --- rules -----------------------------------------------------------------------------------


def _one_rule(name: str, sites: bool = False, plain: bool = False) -> None:
    @over_tables(f"diag_{name}")
    def _(t):
        described = _described(t) if sites else rules.describe(_plain_stats(t) if plain else _stats(t), t.stages)
        return rules.one_rule(described, name, EVAL_MS).select(*ALERT)


_one_rule("long_tail")
_one_rule("shuffle_read_skew", sites=True)
_one_rule("shuffle_write_skew", sites=True)
_one_rule("input_skew")
_one_rule("gc_overhead", plain=True)


@over_tables("diag_scheduler_delay")
def _(t):
    return rules.scheduler_delay_alerts(_stats(t), EVAL_MS).select(*ALERT)


@over_tables("diag_shuffle_read_notice")
def _(t):
    return rules.shuffle_read_notices(t.stages_with_parents, stages.stage_bytes(t.tasks)).select(*ALERT)


@over_tables("diag_heap_pressure")
def _(t):
    return executors.heap_pressure(t.samples, applications.app_configs(t.conf)).select(*ALERT)


@over_tables("diag_unexplained_straggler")
def _(t):
    stragglers = _stragglers(t)
    state = hosts.host_state_asof(stragglers, t.host_names, t.host_clock)
    return rules.straggler_alerts(stragglers, state).select(*ALERT)


@over_tables("diag_executor_lost")
def _(t):
    return executors.lost_executors(t.polls, t.samples).select(*ALERT)


@over_tables("diag_task_failure")
def _(t):
    return failures.failure_alerts(t.tasks).select(*ALERT)


@over_tables("diag_oom_report")
def _(t):
    return failures.oom_reports(_context(t)).select(*ALERT)


@over_tables("diag_all")
def _(t):
    return _diagnose(t)


# --- windows ---------------------------------------------------------------------------------


@over_tables("alert_throttle")
def _(t):
    alerts = rules.task_alerts(_described(t), EVAL_MS).unionByName(
        executors.heap_pressure(t.samples, applications.app_configs(t.conf))
    )
    return throttle.throttle(materialise(alerts, "alerts"), PERIODS).select(*ALERT)


@over_tables("alert_throttle_host")
def _(t):
    stragglers = _stragglers(t)
    alerts = rules.straggler_alerts(stragglers, hosts.host_state_asof(stragglers, t.host_names, t.host_clock))
    return throttle.throttle(materialise(alerts, "alerts"), {"host": 2}).select(*ALERT)


@over_tables("executor_latest_sample")
def _(t):
    return executors.latest_samples(t.samples)


@over_tables("executor_poll_failures")
def _(t):
    return executors.poll_failures(t.polls)


@over_tables("host_counter_rate")
def _(t):
    counters = t.host_samples.filter(F.col("metric").isin(hosts.CPU, hosts.PAGE_IN, hosts.PAGE_OUT))
    return hosts.counter_rates(counters).withColumn("rate", F.round("rate", 6))


# --- hosts -----------------------------------------------------------------------------------


@over_tables("host_load")
def _(t):
    return hosts.host_load(_hosts(t), t.host_names, t.host_samples)


@over_tables("host_cpu_usage")
def _(t):
    return hosts.host_cpu_usage(t.host_samples, t.host_names)


@over_tables("host_memory_available")
def _(t):
    return hosts.host_memory_available(_hosts(t), t.host_names, t.host_samples)


@over_tables("host_io_rate")
def _(t):
    return hosts.host_io_rate(_hosts(t), t.host_names, t.host_samples)


# --- lineage, top-k --------------------------------------------------------------------------


@over_tables("stage_rdd_callsite")
def _(t):
    return lineage.stage_callsites(t.rdds).drop("stage_attempt_id")


@over_tables("top_tasks_per_stage")
def _(t):
    return tasks.top_tasks(t.tasks, EVAL_MS, 5).select(*TASK_KEY, "time_ms", "position")


# --- scalar functions ------------------------------------------------------------------------


def _fmt_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("l_extendedprice") * 1000)
    sizes = base_table(spark, sf_dir, "lineitem").select(n.alias("n"))
    scaled = {"small": "n % 1500", "kilo": "n div 100", "plain": "n", "giga": "n * 997", "tera": "n * 999983"}
    return sizes.select("n", *[fmt_bytes(f"({e})").alias(name) for name, e in scaled.items()])


QUERIES["fmt_bytes"] = _fmt_bytes


@over_tables("fmt_duration")
def _(t):
    return t.view("fx_metrics").select(
        "task_id", fmt_duration("time_ms").alias("text"), fmt_duration("(time_ms * 997)").alias("long_text")
    )


@over_tables("failure_class")
def _(t):
    return tasks.failed_attempts(t.tasks).select(*TASK_KEY, failure_class("failure_reason").alias("class"))


@over_tables("failure_advice")
def _(t):
    return tasks.failed_attempts(t.tasks).select(*TASK_KEY, failure_advice("failure_reason").alias("advice"))


@over_tables("parse_size")
def _(t):
    units = F.array(*[F.lit(u) for u in ("", "b", "k", "kb", "m", "mb", "g", "gb", "t", "tb", "p", "pb", "x")])
    key = F.col("o_orderkey")
    text = F.concat((key % 4096).cast("string"), F.get(units, (key % 13).cast("int")))
    sizes = t.base("orders").select("o_orderkey", text.alias("text"))
    return sizes.select("*", parse_size("text").alias("bytes"))


@over_tables("app_config")
def _(t):
    return applications.app_configs(t.view("fx_settings"))


@over_tables("failure_text")
def _(t):
    ended = t.tasks.filter(F.col("status") != "RUNNING")
    reason = F.from_json(F.to_json(_end_reason()), TASK_END_REASON)
    return ended.select(*TASK_KEY, reason.alias("reason")).select(*TASK_KEY, failure_text("reason").alias("text"))


@over_tables("executor_id_from_path")
def _(t):
    sample = F.concat(F.lit("/jvm/"), F.col("app_id"), F.lit("/executor_"), F.col("executor_id"), F.lit("/metrics"))
    other = F.concat(F.lit("/jvm/"), F.col("app_id"), F.lit("/old_executor_"), F.col("executor_id"))
    return t.samples.select(
        "app_id", "ts_ms", executor_id_from_path(sample).alias("from_sample"),
        executor_id_from_path(other).alias("from_other"),
    )


# --- streams ---------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a stream of files."""
    schema = base_table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _paths(spark: SparkSession) -> tuple[str, str, str]:
    root = scratch_path(spark, "stream")
    return f"{root}/state", f"{root}/out", f"{root}/checkpoint"


def _in_files(df: DataFrame, path: str, n: int, *keys: str) -> DataFrame:
    """A table written as ``n`` files and streamed, one file per micro-batch."""
    df.repartition(n, *keys).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _stage_monitor(t: Tables, hosts_too: bool = False) -> tuple[str, str]:
    """Runs the stage monitor over several files of attempts and stages, then again with a later clock.

    The second run restarts from the checkpoint of the first; the clock lets it judge the completed stages.
    """
    state, out, checkpoint = _paths(t.spark)
    root = scratch_path(t.spark, "stream-in")
    samples = None
    if hosts_too:
        recent = _in_files(t.host_clock, f"{root}/hosts", 2, "ts_ms")
        keep_ms = 10**9  # the evaluation time is fixed, the files are not in order
        host_state.recent_samples(recent, state, f"{checkpoint}-hosts", keep_ms, every=None).awaitTermination()
        samples = host_state.known_samples(state)
    open_stages = t.stages.withColumn("parent_ids", F.lit(None).cast("array<int>"))
    sites = lineage.stage_callsites(t.rdds) if hosts_too else None
    attempts = _in_files(t.tasks, f"{root}/tasks", 3, "task_id")
    told = _in_files(open_stages, f"{root}/stages", 2, "stage_id")
    for turn in range(2):
        stage_state.stage_monitor(
            attempts, told, out, checkpoint, at_ms=EVAL_MS, callsites=sites, host_samples=samples, host_names=t.host_names, every=None
        ).awaitTermination()
        if turn == 0:
            last = str(t.spark.read.parquet(f"{out}/alerts").agg(F.max("batch_id")).first()[0])
            later = open_stages.limit(1).withColumns({
                "app_id": F.lit("clock"), "submission_ms": F.lit(EVAL_MS + 10**9), "completion_ms": F.lit(None).cast("bigint"),
            })
            later.write.mode("append").parquet(f"{root}/stages")
    return out, last


@over_tables("stream_inflight_monitor")
def _(t):
    out, last = _stage_monitor(t)
    alerts = t.spark.read.parquet(f"{out}/alerts").filter(F.col("batch_id") == int(last))
    return alerts.select("app_id", "stage_id", "rule", "task_id", "message")


@over_tables("stream_stage_completed")
def _(t):
    out, _ = _stage_monitor(t)
    return t.spark.read.parquet(f"{out}/completed").drop("batch_id")


@over_tables("stream_completion_alerts")
def _(t):
    out, last = _stage_monitor(t, hosts_too=True)
    return t.spark.read.parquet(f"{out}/alerts").filter(F.col("batch_id") > int(last)).select(*ALERT)


@over_tables("stream_executor_rollup")
def _(t):
    state, out, checkpoint = _paths(t.spark)
    root = scratch_path(t.spark, "stream-in")
    ends = t.apps.select("app_id", F.lit(EVAL_MS).cast("bigint").alias("end_ms"))
    clock = ends.select(F.lit("clock").alias("app_id"), F.lit(EVAL_MS + 10**6).cast("bigint").alias("end_ms")).limit(1)
    records = executor_state.executor_records(
        _in_files(t.executors, f"{root}/executors", 2, "executor_id"), _in_files(t.tasks, f"{root}/tasks", 3, "task_id"),
        _in_files(t.samples, f"{root}/samples", 3, "ts_ms"), _in_files(ends, f"{root}/ends", 1),
    )
    for turn in range(2):
        # The files are not in order of time, so nobody is reported before the clock has moved.
        executor_state.leaving_executors(records, state, out, checkpoint, lateness_ms=900_000).awaitTermination()
        if turn == 0:
            clock.write.mode("append").parquet(f"{root}/ends")
    return t.spark.read.parquet(out).drop("batch_id")


@over_tables("stream_shuffle_notice")
def _(t):
    state, out, checkpoint = _paths(t.spark)
    root = scratch_path(t.spark, "stream-in")
    ends = t.apps.select("app_id", F.lit(EVAL_MS).cast("bigint").alias("end_ms"))
    clock = ends.select(F.lit("clock").alias("app_id"), F.lit(EVAL_MS + 10**10).cast("bigint").alias("end_ms")).limit(1)
    records = notices.notice_records(
        _in_files(t.stages_with_parents, f"{root}/stages", 2, "stage_id"), _in_files(t.tasks, f"{root}/tasks", 3, "task_id"),
        _in_files(ends, f"{root}/ends", 1),
    )
    for turn in range(2):
        # The files are not in order of time, so no stage is judged before the clock has moved.
        notices.read_notices(records, state, out, checkpoint, lateness_ms=10**10 - 1).awaitTermination()
        if turn == 0:
            clock.write.mode("append").parquet(f"{root}/ends")
    return t.spark.read.parquet(out).select(*ALERT)


@over_tables("stream_state_expiry")
def _(t):
    state, out, checkpoint = _paths(t.spark)
    alerts = executors.heap_pressure(_streamed(t, "events").samples, applications.app_configs(t.conf))
    query = monitors.throttled_alerts(alerts, state, out, checkpoint, PERIODS, keep_ms=EXPIRY_MS)
    query.awaitTermination()
    left = BatchTable(state, monitors.COUNTERS).before(t.spark, query.lastProgress["batchId"] + 1)
    return left.select("app_id", F.col("counter_executor").alias("executor_id"), "fired", "last_ms")


def _streamed(t: Tables, name: str) -> Tables:
    return Tables(t.spark, t.sf_dir, **{name: _stream(t.spark, t.sf_dir, name)})


@over_tables("stream_stage_progress")
def _(t):
    _, out, checkpoint = _paths(t.spark)
    monitors.stage_progress(_streamed(t, "orders").tasks, out, checkpoint).awaitTermination()
    return monitors.progress_totals(t.spark.read.parquet(out))


@over_tables("stream_heap_monitor")
def _(t):
    _, stats_out, stats_checkpoint = _paths(t.spark)
    _, alert_out, alert_checkpoint = _paths(t.spark)
    samples = _streamed(t, "events").samples
    running = [
        monitors.heap_stats(samples, stats_out, stats_checkpoint),
        monitors.heap_alerts(samples, alert_out, alert_checkpoint, applications.app_configs(t.conf)),
    ]
    for query in running:
        query.awaitTermination()
    alerts = t.spark.read.parquet(alert_out).groupBy("app_id", "executor_id").agg(F.count(F.lit(1)).alias("alerts"))
    totals = monitors.heap_totals(t.spark.read.parquet(stats_out))
    return totals.join(alerts, ["app_id", "executor_id"], "left").fillna(0, ["alerts"])


@over_tables("stream_alert_throttle")
def _(t):
    state, out, checkpoint = _paths(t.spark)
    alerts = executors.heap_pressure(_streamed(t, "events").samples, applications.app_configs(t.conf))
    monitors.throttled_alerts(alerts, state, out, checkpoint, PERIODS).awaitTermination()
    return t.spark.read.parquet(out).select(*ALERT)


@over_tables("stream_executor_lost")
def _(t):
    _, out, checkpoint = _paths(t.spark)
    monitors.lost_executors(_streamed(t, "events").polls, out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).select("app_id", "executor_id", "ts_ms")


@over_tables("stream_task_failures")
def _(t):
    _, out, checkpoint = _paths(t.spark)
    monitors.task_failures(_streamed(t, "orders").tasks, out, checkpoint).awaitTermination()
    return t.spark.read.parquet(out).select(*ALERT)
