"""Streams fed in several files equal the batch operators over all rows."""

import pandas as pd
from pyspark.sql import functions as F

from checks.fixtures import EVAL_MS
from checks.queries import _event_lines
from jobscope.operators import executors, failures, hosts, rules, stages, throttle
from jobscope.sinks import graphite_lines
from jobscope.sinks.records import failure_records
from jobscope.sources import stream_ended_attempts
from jobscope.streaming import host_state, monitors, stage_state
from jobscope.streaming.state import BatchTable

ALERT_ORDER = ["app_id", "rule", "stage_id", "executor_id", "eval_ms", "message"]


def in_files(spark, df, path, order, n):
    """Writes a table as ``n`` files in order of time and streams one file per micro-batch."""
    total = df.count()
    ranked = df.orderBy(*order).collect()
    for i in range(n):
        part = ranked[i * total // n: (i + 1) * total // n]
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def paths(tmp_path):
    return str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp")


def test_throttle_over_several_batches(spark, tables, tmp_path):
    alerts = executors.heap_pressure(
        tables.samples.withColumn("heap_used", F.col("heap_used") * 4)
    )
    state, out, checkpoint = paths(tmp_path)
    stream = in_files(spark, alerts, str(tmp_path / "in"), ["eval_ms"], 4)
    monitors.throttled_alerts(stream, state, out, checkpoint, {"heap": 3}).awaitTermination()
    expected = throttle.throttle(alerts, {"heap": 3})
    found = spark.read.parquet(out)
    assert found.select("batch_id").distinct().count() == 4
    assert sorted(found.select(*ALERT_ORDER).collect()) == sorted(expected.select(*ALERT_ORDER).collect())
    assert expected.count() < alerts.count()


def test_lost_executors_over_several_batches(spark, tables, tmp_path):
    _, out, checkpoint = paths(tmp_path)
    stream = in_files(spark, tables.polls, str(tmp_path / "in"), ["ts_ms"], 5)
    monitors.lost_executors(stream, out, checkpoint).awaitTermination()
    expected = executors.lost_executors(tables.polls).select("app_id", "executor_id", F.col("eval_ms").alias("ts_ms"))
    found = spark.read.parquet(out).select(*expected.columns)
    assert sorted(found.collect()) == sorted(expected.collect()) and found.count() == 10


def test_progress_over_several_batches(spark, tables, tmp_path):
    _, out, checkpoint = paths(tmp_path)
    ended = tables.tasks.filter("status <> 'RUNNING'")
    stream = in_files(spark, ended, str(tmp_path / "in"), ["finish_ms"], 3)
    monitors.stage_progress(stream, out, checkpoint).awaitTermination()
    expected = stages.finished_counts(ended)
    found = monitors.progress_totals(spark.read.parquet(out)).select(*expected.columns)
    assert sorted(found.collect()) == sorted(expected.collect())


def test_heap_over_several_batches(spark, tables, tmp_path):
    _, out, checkpoint = paths(tmp_path)
    stream = in_files(spark, tables.samples, str(tmp_path / "in"), ["ts_ms"], 3)
    monitors.heap_stats(stream, out, checkpoint).awaitTermination()
    expected = executors.heap_stats(tables.samples)
    found = monitors.heap_totals(spark.read.parquet(out)).select(*expected.columns)
    assert sorted(found.collect()) == sorted(expected.collect())


def test_failures_over_several_batches(spark, tables, tmp_path):
    _, out, checkpoint = paths(tmp_path)
    stream = in_files(spark, tables.tasks, str(tmp_path / "in"), ["task_id"], 2)
    monitors.task_failures(stream, out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 199 + 199 - 18


def as_running(df):
    return df.withColumns({
        "status": F.lit("RUNNING"), "finish_ms": F.lit(None).cast("bigint"),
        "duration_ms": F.lit(None).cast("bigint"), "failure_reason": F.lit(None).cast("string"),
    })


def told(df):
    return df.select("app_id", "stage_id", "stage_attempt_id", "name", "num_tasks", "submission_ms", "completion_ms", "failure_reason")


def files(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def put(df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))


def test_stages_are_judged_from_their_state(spark, tables, tmp_path):
    """Attempts are told running, then ended, some twice; stages come late and in two parts; the monitor is restarted in
    between.  Open stages equal the batch rules, completed ones equal the batch and come once."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    stage_table = told(tables.stages)
    opened = stage_table.withColumns({"completion_ms": F.lit(None).cast("bigint"), "failure_reason": F.lit(None).cast("string")})
    in_tasks, in_stages = tmp_path / "tasks", tmp_path / "stages"

    def run():
        stage_state.stage_monitor(
            files(spark, tables.tasks.schema, in_tasks), files(spark, stage_table.schema, in_stages), out, checkpoint, at_ms=EVAL_MS, every=None
        ).awaitTermination()

    def alerts():
        return spark.read.parquet(f"{out}/alerts")

    put(as_running(tables.tasks), in_tasks)
    put(opened.filter("stage_id < 20"), in_stages)
    run()
    assert not (tmp_path / "out").exists()  # nothing had ended, so no stage was due
    put(tables.tasks, in_tasks)
    put(as_running(tables.tasks.filter("task_id % 3 = 0")).unionByName(tables.tasks.filter("task_id % 5 = 0")), in_tasks)
    put(opened.filter("stage_id >= 20"), in_stages)
    put(stage_table, in_stages)
    run()

    ready = stages.half_finished(tables.stages, stages.finished_counts(tables.tasks))
    judged = tables.tasks.join(ready, ["app_id", "stage_id", "stage_attempt_id"], "left_semi")
    described = rules.describe(stages.stage_stats(judged, EVAL_MS), tables.stages)
    expected = rules.task_alerts(described, EVAL_MS, only_running=True)
    still_open = tables.stages.filter("completion_ms IS NULL").select("app_id", "stage_id")
    last = alerts().agg(F.max("batch_id")).first()[0]
    found = alerts().filter(F.col("batch_id") == last).join(still_open, ["app_id", "stage_id"], "left_semi").select(*expected.columns)
    assert sorted(found.collect()) == sorted(expected.collect()) and found.count() > 0
    assert spark.read.parquet(f"{out}/completed").count() == 0  # attempts of completed stages are still running

    # The clock passes the completion; completion records and attempts that come again change nothing.
    clock = opened.limit(1).withColumns({"app_id": F.lit("clock"), "submission_ms": F.lit(EVAL_MS + 10**9)})
    put(clock, in_stages)
    run()
    put(stage_table, in_stages)
    put(tables.tasks, in_tasks)
    run()
    summaries = stages.stage_summary(tables.stages, tables.tasks)
    assert sorted(spark.read.parquet(f"{out}/completed").select(*summaries.columns).collect()) == sorted(summaries.collect())
    done = tables.tasks.join(tables.stages.filter("completion_ms IS NOT NULL"), ["app_id", "stage_id", "stage_attempt_id"], "left_semi")
    described = rules.describe(stages.stage_stats(done, EVAL_MS), tables.stages)
    expected = rules.all_stage_alerts(described, EVAL_MS)
    found = alerts().filter(F.col("batch_id") > last).join(still_open, ["app_id", "stage_id"], "left_anti").select(*expected.columns)
    assert sorted(found.collect()) == sorted(expected.collect()) and found.count() > 0


def test_stage_state_leaves(spark, tables, tmp_path):
    """State rows of completed and of silent stages go when the clock has passed them."""
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    stage_table = told(tables.stages)
    put(tables.tasks, tmp_path / "tasks")
    put(stage_table, tmp_path / "stages")

    def state_rows():
        query = stage_state.stage_monitor(
            files(spark, tables.tasks.schema, tmp_path / "tasks"), files(spark, stage_table.schema, tmp_path / "stages"), out, checkpoint,
            at_ms=EVAL_MS, every=None, keep_ms=3_600_000,
        )
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    before = state_rows()
    clock = stage_table.limit(1).withColumns({"app_id": F.lit("clock"), "completion_ms": F.lit(None).cast("bigint")})
    seen = []
    for hours in (1, 3, 6):
        put(clock.withColumns({"submission_ms": F.lit(EVAL_MS + hours * 3_600_000), "stage_id": F.lit(hours)}), tmp_path / "stages")
        seen.append(state_rows())
    assert before >= 48 and seen[-1] <= 3 < seen[0], (before, seen)


def test_chunks_of_a_stage_are_merged(monkeypatch):
    """Rows told again and again do not pile up, and of each attempt the right row is left."""
    class Handle:
        def getListState(self, *_):
            return self

        getValueState = getListState
        held, value = [], None

        def appendValue(self, row):
            self.held.append(row)

        def get(self):
            return iter(self.held)

        def put(self, rows):
            self.held = list(rows)

    state = stage_state.StageState(0.5, 1, 1)
    state.init(handle := Handle())
    stage = {"chunks": 0, "ended": 0, "num_tasks": 10}
    names = stage_state._ATTEMPT.names
    for turn in range(1, 41):
        rows = pd.DataFrame([{**dict.fromkeys(names), "task_id": i, "launch_ms": turn, "status": "SUCCESS" if turn == 20 and i < 3 else "RUNNING"} for i in range(10)])
        handle.appendValue((stage_state._packed(stage_state._table(rows.assign(turn=turn))),))
        stage["chunks"] += 1
        latest = stage_state._latest(stage_state._frame(state._known(stage)))
        assert len(handle.held) <= stage_state.MOST_CHUNKS + 1 and len(latest) == 10
    assert sorted(latest.loc[latest["status"] == "SUCCESS", "launch_ms"]) == [20] * 3
    assert set(latest.loc[latest["status"] == "RUNNING", "launch_ms"]) == {40}
    stage["ended"] = 12
    assert not state._all_ended(stage) and stage["ended"] == 3


def test_counters_leave(spark, tables, tmp_path):
    """Throttle counters go some time after their last alert, or when their application has ended; poll counters by timer."""
    state, out, checkpoint = paths(tmp_path)
    alerts = executors.heap_pressure(tables.samples.withColumn("heap_used", F.col("heap_used") * 4))
    stream = in_files(spark, alerts, str(tmp_path / "in"), ["eval_ms"], 4)
    ended = alerts.select("app_id").distinct().orderBy("app_id").limit(1)
    monitors.throttled_alerts(stream, state, out, checkpoint, {"heap": 3}, keep_ms=100_000, ended=lambda _: ended).awaitTermination()
    left = BatchTable(state, monitors.COUNTERS).before(spark, 4)
    newest = alerts.agg(F.max("eval_ms")).first()[0]
    alive = alerts.filter(F.col("eval_ms") > newest - 100_000).join(ended, "app_id", "left_anti").select("app_id", "executor_id").distinct()
    everyone = alerts.select("app_id", "executor_id").distinct().count()
    assert 0 < left.count() == alive.count() < everyone
    assert left.join(ended, "app_id", "left_semi").isEmpty() and left.filter(F.col("last_ms") <= newest - 100_000).isEmpty()

    polls = tables.polls.withColumn("ts_ms", F.when(F.col("executor_id") == "3", F.col("ts_ms")).otherwise(F.col("ts_ms") + 10**9))
    stream = in_files(spark, polls, str(tmp_path / "polls"), ["ts_ms"], 3)
    rows = []
    for _ in range(2):
        query = monitors.lost_executors(stream, str(tmp_path / "lost"), str(tmp_path / "cp2"), lateness="1 second", keep_ms=1000)
        query.awaitTermination()
        rows += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
        put(polls.limit(1).withColumns({"app_id": F.lit("later"), "ok": F.lit(False), "ts_ms": F.lit(10**10).cast("bigint")}), tmp_path / "polls")
    assert rows[-1] < max(rows)


def test_recent_host_samples(spark, tables, tmp_path):
    """The kept window answers as the whole table does, and holds no more than its minutes."""
    stream = in_files(spark, tables.host_clock, str(tmp_path / "in"), ["ts_ms"], 5)
    state = str(tmp_path / "state")
    host_state.recent_samples(stream, state, str(tmp_path / "cp"), every=None).awaitTermination()
    kept = host_state.known_samples(state)(spark)
    probes = tables.executors.select("host").distinct().withColumn("eval_ms", F.lit(EVAL_MS).cast("bigint"))
    expected = hosts.host_state_asof(probes, tables.host_names, tables.host_clock)
    assert sorted(map(str, hosts.host_state_asof(probes, tables.host_names, kept).collect())) == sorted(map(str, expected.collect()))
    assert kept.agg(F.min("ts_ms")).first()[0] > EVAL_MS - host_state.KEEP_MS and 0 < kept.count() < tables.host_clock.count()


def test_event_log_files_as_a_stream(spark, tables, tmp_path):
    """Log files moved into a folder, one per application, give the failures of the batch."""
    lines = _event_lines(tables.tasks)
    for app in ("app_0", "app_1", "app_2", "app_3"):
        lines.filter(F.col("app_id") == app).select("value").coalesce(1).write.text(
            str(tmp_path / "in" / f"eventlog_v2_{app}")
        )
    _, out, checkpoint = paths(tmp_path)
    stream = stream_ended_attempts(spark, str(tmp_path / "in"))
    monitors.task_failures(stream, out, checkpoint).awaitTermination()
    expected = failures.failure_alerts(tables.tasks).select(*ALERT_ORDER)
    assert sorted(spark.read.parquet(out).select(*ALERT_ORDER).collect()) == sorted(expected.collect())


def test_delivery_of_a_stream(spark, tables, tmp_path):
    records = failure_records(tables.tasks)
    stream = in_files(spark, records, str(tmp_path / "in"), ["eval_ms"], 2)
    log, events = str(tmp_path / "log"), str(tmp_path / "events")
    monitors.delivered(stream, log, str(tmp_path / "cp"), "graphite", events).awaitTermination()
    assert spark.read.text(log).count() == records.count()
    points = graphite_lines(records, "eval_ms div 1000").select("line")
    assert sorted(r["value"] for r in spark.read.text(events).collect()) == sorted(r["line"] for r in points.collect())


def _pack_of(names, rows, turn=0):
    return stage_state._packed(stage_state._table(pd.DataFrame([{**dict.fromkeys(names), **r} for r in rows]).assign(turn=turn)))


class _Held:
    """State of one stage, as far as its processor asks for it."""

    def __init__(self):
        self.rows, self.value, self.timers = [], None, []

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return self.Value(self)

    class Value:
        def __init__(self, held):
            self.held = held

        def exists(self):
            return self.held.value is not None

        def get(self):
            return self.held.value

        def update(self, value):
            self.held.value = value

    def appendValue(self, row):
        self.rows.append(row)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers = [at]

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Clock:
    def getCurrentWatermarkInMs(self):
        return 0


def test_a_large_stage_is_held_and_handed_out_in_packs(monkeypatch):
    """However many attempts a stage has, no chunk and no frame holds more than a few of them."""
    monkeypatch.setattr(stage_state, "CHUNK_ROWS", 50)
    names = stage_state._ATTEMPT.names
    state = stage_state.StageState(0.5, 1, 1)
    state.init(held := _Held())
    facts = dict.fromkeys(stage_state._FACTS) | {"num_tasks": 1000, "submission_ms": 1}
    told = [{**facts, "rows": None}] + [
        {**dict.fromkeys(facts), "rows": _pack_of(names, [{"task_id": i, "status": "SUCCESS"} for i in range(j, j + 40)])} for j in range(0, 1000, 40)
    ]
    frames = list(state.handleInputRows(("app", 1, 0), iter([pd.DataFrame([r]) for r in told]), _Clock()))
    sizes = [len(stage_state._unpacked(x)) for x, in held.rows]
    assert sum(sizes) == 1000 and max(sizes) <= 2 * 50
    handed = [stage_state._unpacked(f["rows"][0]) for f in frames[1:]]
    assert all(len(f) == 1 for f in frames) and frames[0]["rows"][0] is None
    assert max(map(len, handed)) <= 2 * 50 and sorted(i for x in handed for i in x["task_id"].to_pylist()) == list(range(1000))


def test_replaced_rows_stay_and_rivals_are_marked():
    """Of each attempt only the row that counts is handed out; rows of one turn that are alike in that are all."""
    names = stage_state._ATTEMPT.names
    state = stage_state.StageState(0.5, 1, 1)
    state.init(_Held())
    running = [{"task_id": i, "status": "RUNNING", "launch_ms": 1} for i in range(6)]
    ended = [{"task_id": i, "status": "SUCCESS", "launch_ms": 2} for i in range(4)] + [{"task_id": 3, "status": "FAILED", "launch_ms": 3}]
    facts = dict.fromkeys(stage_state._FACTS)
    frames = []
    for rows in (running, ended, running):
        told = pd.DataFrame([{**facts, "num_tasks": 6, "submission_ms": 1, "rows": None}, {**facts, "rows": _pack_of(names, rows)}])
        frames = list(state.handleInputRows(("app", 1, 0), iter([told]), _Clock()))
    handed = {bool(f["rivals"][0]): stage_state._unpacked(f["rows"][0]).to_pylist() for f in frames[1:] if f["rivals"][0]}
    assert sorted(r["status"] for r in handed[True]) == ["FAILED", "SUCCESS"]
    single = [r for f in frames[1:] if not f["rivals"][0] for r in stage_state._unpacked(f["rows"][0]).to_pylist()]
    assert sorted((r["task_id"], r["status"], r["turn"]) for r in single) == [
        (0, "SUCCESS", 2), (1, "SUCCESS", 2), (2, "SUCCESS", 2), (4, "RUNNING", 3), (5, "RUNNING", 3)
    ]


def test_attempts_are_packed_by_stage(spark, tables, monkeypatch):
    """Few packs come to the state instead of a row per attempt; they hold every attempt, running ones apart."""
    odd = tables.tasks.limit(3).withColumns({"task_id": F.lit(None).cast("bigint"), "app_id": F.lit(None).cast("string")})
    told = tables.tasks.unionByName(odd).coalesce(1)
    packs = stage_state.attempt_rows(told).collect()
    assert len(packs) < 0.5 * told.count()
    rows = [(p, r) for p in packs for r in stage_state._unpacked(p["rows"]).to_pylist()]
    expected = tables.tasks.select("app_id", "stage_id", "task_id", "finish_ms", "failure_reason").collect()
    assert sorted(map(str, ((p["app_id"], p["stage_id"], r["task_id"], r["finish_ms"], r["failure_reason"]) for p, r in rows))) == sorted(str(tuple(r)) for r in expected)
    for p, r in rows:
        assert (p["at"] is None) == (r["finish_ms"] is None)
    assert {p["app_id"] for p in packs} >= {None}
