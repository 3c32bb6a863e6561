"""Properties of the rules, the throttle and the joins, on small tables made for the purpose."""

import pytest

from checks.fixtures import EVAL_MS, HALF_MS
from jobscope.operators import applications, executors, failures, hosts, lineage, rules, stages, tasks, throttle
from jobscope.plans import Telemetry, diagnose
from jobscope.schemas import TASK_ATTEMPTS
from jobscope.settings import Thresholds
from pyspark.sql import functions as F

def attempts(spark, rows):
    """Task table from dicts; what is not given is null, as in a feed with optional metrics."""
    names = [part.split()[0] for part in TASK_ATTEMPTS.split(", ")]
    base = {"app_id": "a", "stage_id": 1, "stage_attempt_id": 0, "executor_id": "1", "host": "h",
            "status": "SUCCESS", "launch_ms": 0}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], TASK_ATTEMPTS)


def stats_of(spark, rows, **kw):
    return stages.stage_stats(attempts(spark, rows), 100_000, **kw).first()


def test_missing_metrics_count_as_zero(spark):
    row = stats_of(spark, [{"task_id": i, "duration_ms": None} for i in range(3)])
    assert (row["time_max"], row["input_max"], row["gc_max"], row["time_task_id"]) == (0, 0, 0, -1)
    assert (row["input_bytes"], row["time_host"], row["time_running"]) == (0, "", False)


def test_ties_go_to_the_longest_then_lowest_task(spark):
    rows = [
        {"task_id": 5, "duration_ms": 10, "shuffle_read_records": 7},
        {"task_id": 3, "duration_ms": 20, "shuffle_read_records": 7},
        {"task_id": 2, "duration_ms": 20, "shuffle_read_records": 7},
    ]
    row = stats_of(spark, rows)
    assert (row["read_task_id"], row["time_task_id"], row["write_task_id"]) == (2, 2, -1)


def test_input_counts_success_or_old_and_not_failed(spark):
    rows = [
        {"task_id": 1, "duration_ms": 1, "input_records": 10},
        {"task_id": 2, "status": "FAILED", "duration_ms": 99_000, "input_records": 9_000},
        {"task_id": 3, "status": "KILLED", "duration_ms": 10_000, "input_records": 8_000},
        {"task_id": 4, "status": "KILLED", "duration_ms": 10_001, "input_records": 31},
        {"task_id": 5, "status": "RUNNING", "launch_ms": 95_000, "input_records": 7_000},
    ]
    row = stats_of(spark, rows)
    assert (row["input_max"], row["input_task_id"], row["input_mid"]) == (31, 4, 20)


def test_no_eligible_input_gives_no_alert(spark):
    rows = [{"task_id": i, "status": "FAILED", "duration_ms": 5, "input_records": 10**6 * i} for i in range(5)]
    row = stats_of(spark, rows)
    assert (row["input_mid"], row["input_p75"], row["input_max"]) == (0, 0, 0)


def test_scaling_records_keeps_ratios(tables):
    ratio = ("round((read_max - read_mid) / nullif(read_mid, 0), 3)",)
    plain = stages.stage_stats(tables.tasks, EVAL_MS)
    scaled = stages.stage_stats(
        tables.tasks.withColumn("shuffle_read_records", F.col("shuffle_read_records") * 1000), EVAL_MS
    )
    a = plain.selectExpr("stage_id", "read_task_id", *[f"{r} AS r" for r in ratio]).filter("read_mid > 500")
    b = scaled.selectExpr("stage_id", "read_task_id", "read_mid", *[f"{r} AS r" for r in ratio])
    both = a.join(b.withColumnsRenamed({"r": "r2", "read_task_id": "t2"}), "stage_id").collect()
    assert both and all(x["read_task_id"] == x["t2"] and abs(x["r"] - x["r2"]) < 0.01 for x in both)


def test_unexplained_stragglers_are_long_tails(tables):
    described = rules.describe(stages.stage_stats(tables.tasks, EVAL_MS), tables.stages)
    tails = {(r["stage_id"], r["task_id"]) for r in rules.one_rule(described, "long_tail", EVAL_MS).collect()}
    alone = {(r["stage_id"], r["task_id"]) for r in rules.unexplained_stragglers(described, EVAL_MS).collect()}
    assert alone and alone < tails


def test_one_rule_equals_its_part_of_all_rules(tables):
    described = rules.describe(stages.stage_stats(tables.tasks, EVAL_MS), tables.stages).cache()
    for only_running in (False, True):
        together = rules.task_alerts(described, EVAL_MS, only_running=only_running)
        for name in rules.task_rules():
            one = rules.one_rule(described, name, EVAL_MS, only_running=only_running)
            assert sorted(one.collect()) == sorted(together.filter(F.col("rule") == name).collect())


def test_thresholds_are_parameters(tables):
    described = rules.describe(stages.stage_stats(tables.tasks, EVAL_MS), tables.stages)
    none = Thresholds(long_tail_gap_ms=10**9, shuffle_gap_records=10**9, input_gap_records=10**9, gc_ms=10**9)
    assert rules.task_alerts(described, EVAL_MS, none).isEmpty()


def test_scheduler_delay_without_run_time(spark):
    rows = [{"task_id": i, "stage_id": 1, "duration_ms": 100, "run_ms": 0} for i in range(3)]
    rows += [{"task_id": 9, "stage_id": 2, "duration_ms": 0, "run_ms": 0}]
    rows += [{"task_id": 10, "stage_id": 3, "status": "FAILED", "duration_ms": 100}]
    stats = stages.stage_stats(attempts(spark, rows), 100_000)
    alerts = rules.scheduler_delay_alerts(stats, 100_000).collect()
    assert [r["stage_id"] for r in alerts] == [1]
    assert alerts[0]["message"] == "stage 1 average task time: 0.0 ms, average delay 100.0 ms"


def test_parent_of_several_attempts_counts_its_last(spark):
    written = spark.createDataFrame(
        [("a", 1, 0, 100), ("a", 1, 1, 30), ("b", 1, 0, 7)],
        "app_id string, stage_id int, stage_attempt_id int, shuffle_write_bytes bigint",
    )
    known = spark.createDataFrame(
        [("a", 2, 0, "s", 4, [1, 99], 5)],
        "app_id string, stage_id int, stage_attempt_id int, name string, num_tasks bigint, parent_ids array<int>, submission_ms bigint",
    )
    assert stages.parent_shuffle(known, written).first()["parent_shuffle_bytes"] == 30


def test_throttle_of_one_is_the_identity_and_counts_follow_the_period(tables):
    described = rules.describe(stages.stage_stats(tables.tasks, EVAL_MS), tables.stages)
    alerts = rules.one_rule(described, "long_tail", EVAL_MS).cache()
    assert sorted(throttle.throttle(alerts, {"long_tail": 1}).collect()) == sorted(alerts.collect())
    assert throttle.throttle(alerts, {"long_tail": 3}).count() == 7
    assert throttle.throttle(alerts).count() == 4


def test_skew_rules_share_a_counter_and_others_pass(spark):
    def alert(rule, ordinal, stage):
        return ("a", "E", "WARN", rule, stage, 0, 1, None, 5, ordinal, rule)

    columns = ("app_id string, event string, level string, rule string, stage_id int, stage_attempt_id int, "
               "task_id bigint, executor_id string, eval_ms bigint, rule_ord int, message string")
    rows = [alert("shuffle_read_skew", 2, 1), alert("shuffle_write_skew", 3, 1), alert("input_skew", 4, 1),
            alert("shuffle_read_skew", 2, 5000), alert("scheduler_delay", 7, 1), alert("scheduler_delay", 7, 2)]
    passed = throttle.throttle(spark.createDataFrame(rows, columns), {"skew": 2}).collect()
    assert sorted((r["rule"], r["stage_id"]) for r in passed) == [
        ("input_skew", 1), ("scheduler_delay", 1), ("scheduler_delay", 2), ("shuffle_read_skew", 1)
    ]


def test_snapshot_then_later(tables):
    at = tasks.snapshot_at(tables.tasks, HALF_MS)
    assert at.filter("launch_ms > %d" % HALF_MS).isEmpty()
    assert at.filter("status <> 'RUNNING' AND finish_ms > %d" % HALF_MS).isEmpty()
    assert at.filter("status = 'RUNNING' AND duration_ms IS NOT NULL").isEmpty()


def test_task_list_is_ordered(tables):
    listed = tasks.task_list(tables.tasks, EVAL_MS, "stage_id = 5").collect()
    times = [r["time_ms"] for r in listed]
    assert times == sorted(times, reverse=True) and {r["stage_id"] for r in listed} == {5}


def test_heap_pressure_uses_the_configured_memory(tables):
    configs = applications.app_configs(tables.conf)
    found = executors.heap_pressure(tables.samples, configs)
    assert {r["app_id"] for r in found.select("app_id").distinct().collect()} <= {"app_2", "app_3"}


def test_executor_lost_without_samples_has_no_info(spark):
    polls = spark.createDataFrame(
        [("a", "1", 1, False), ("a", "1", 2, True), ("a", "1", 3, False), ("a", "1", 4, False), ("a", "1", 5, False),
         ("a", "2", 1, False), ("a", "2", 2, False)],
        "app_id string, executor_id string, ts_ms bigint, ok boolean",
    )
    samples = spark.createDataFrame([], "app_id string, executor_id string, ts_ms bigint, heap_used bigint")
    lost = executors.lost_executors(polls, samples).collect()
    assert [(r["executor_id"], r["eval_ms"], r["message"]) for r in lost] == [
        ("1", 4, "lost executor_1 3 times, jvm info: ")
    ]


def test_unknown_executor_makes_no_row_and_idle_one_counts_zero(spark):
    known = spark.createDataFrame(
        [("a", "1", "h", 2, 100, None), ("a", "2", "h", 2, 100, 400), ("a", "driver", "h", 1, 0, None)],
        "app_id string, executor_id string, host string, cores int, added_ms bigint, removed_ms bigint",
    )
    work = attempts(spark, [{"task_id": 1, "executor_id": "9"}, {"task_id": 2, "executor_id": "1"}])
    samples = spark.createDataFrame([("a", "1", 1, 5), ("a", "1", 2, 8)],
                                    "app_id string, executor_id string, ts_ms bigint, heap_used bigint")
    found = executors.executor_rollup(known, work, samples, 1100).orderBy("executor_id").collect()
    assert [(r["executor_id"], r["elapsed_ms"], r["completed_tasks"], r["avg_heap"], r["max_heap"]) for r in found] == [
        ("1", 1000, 1, 6, 8), ("2", 300, 0, 0, 0)
    ]


def samples_of(spark, rows):
    return spark.createDataFrame(
        rows, "metric string, instance string, mode string, cpu string, ts_ms bigint, value double"
    )


def test_counter_rate_ranges_resets_and_slices(spark):
    hour = 3_600_000
    series = [(hour - 2000, 10.0), (hour - 1000, 12.0), (hour + 1000, 18.0), (hour + 60_000, 4.0), (hour + 400_000, 9.0)]
    rows = [("c", "i", None, None, ts, v) for ts, v in series]
    rates = {r["ts_ms"]: r["rate"] for r in hosts.counter_rates(samples_of(spark, rows)).collect()}
    assert rates[hour - 2000] is None
    assert rates[hour - 1000] == 2.0
    assert abs(rates[hour + 1000] - 8 / 3) < 1e-12  # three samples within 5 s, across the hour
    assert abs(rates[hour + 60_000] - 4 / 59) < 1e-12  # a reset, by the last two samples
    assert rates[hour + 400_000] is None  # the sample before is older than 5 minutes


def test_cpu_usage_chooses_the_rate_per_mode_after_the_sum(spark):
    at = 300_000
    rows = [
        # user: one core has a 5 s rate, the other only an instantaneous one, which is then not used.
        ("node_cpu", "i", "user", "0", at - 4000, 1.0), ("node_cpu", "i", "user", "0", at, 3.0),
        ("node_cpu", "i", "user", "1", at - 60_000, 1.0), ("node_cpu", "i", "user", "1", at - 10_000, 51.0),
        # idle: no 5 s rate at all.
        ("node_cpu", "i", "idle", "0", at - 60_000, 1.0), ("node_cpu", "i", "idle", "0", at - 10_000, 26.0),
        ("node_cpu", "i", "iowait", "0", at - 60_000, 1.0), ("node_cpu", "i", "iowait", "0", at - 10_000, 26.0),
    ]
    evals = spark.createDataFrame([("i", at)], "instance string, eval_ms bigint")
    samples = samples_of(spark, rows)
    expected = {"user": 25.0, "idle": 50.0}
    for seen in (hosts.at_times(samples, evals), hosts.at_ticks(samples)):
        assert {r["mode"]: r["usage"] for r in hosts.cpu_usage(seen).collect()} == expected


def test_fine_ticks_see_each_sample_until_it_is_too_old(spark):
    seen = hosts.at_ticks(samples_of(spark, [("m", "i", None, None, 61_000, 1.0)]), 60_000)
    assert sorted(r["eval_ms"] for r in seen.collect()) == [120_000, 180_000, 240_000, 300_000, 360_000]


def test_memory_falls_back_and_unresolved_hosts(spark):
    rows = [("node_memory_MemFree", "i", None, None, 1, 5.0), ("node_memory_Buffers", "i", None, None, 1, 2.0),
            ("node_memory_Cached", "i", None, None, 1, 1.0), ("node_memory_MemFree", "j", None, None, 1, 9.0)]
    names = spark.createDataFrame([("h1", "i"), ("h1", "k"), ("h2", "j")], "nodename string, instance string")
    known = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "host string")
    found = hosts.host_memory_available(known, names, samples_of(spark, rows), 1000).collect()
    assert {r["host"]: r["available_bytes"] for r in found} == {"h1": 8, "h2": 0, "h3": 0}
    loads = hosts.host_load(known, names, samples_of(spark, rows), 1000).collect()
    assert all(r["load1"] is None for r in loads) and len(loads) == 3
    stale = samples_of(spark, [("node_load1", "i", None, None, 1, 7.0)])
    assert {r["host"]: r["load1"] for r in hosts.host_load(known, names, stale, 1000).collect()}["h1"] == 7.0
    assert all(r["load1"] is None for r in hosts.host_load(known, names, stale, 86_400_000).collect())


def test_diagnose_with_only_tasks_and_stages(tables):
    found = diagnose(Telemetry(tasks=tables.tasks, stages=tables.stages), EVAL_MS)
    names = {r["rule"] for r in found.select("rule").distinct().collect()}
    assert names == {*rules.task_rules(), "scheduler_delay", "task_failed", "task_failure_cause"}


def test_failure_alerts_equal_their_parts(tables):
    apart = failures.failure_events(tables.tasks).unionByName(failures.failure_causes(tables.tasks))
    assert sorted(apart.collect()) == sorted(failures.failure_alerts(tables.tasks).select(*apart.columns).collect())


RDDS = "app_id string, stage_id int, stage_attempt_id int, rdd_id bigint, parent_ids array<bigint>, callsite string"


@pytest.mark.parametrize("in_row", [0, 512])
def test_call_sites_of_repeated_circular_and_parted_lineage(spark, in_row):
    """In a row or by joins, the walk ends alike: at a fork, outside the stage, on a circle, told twice or not."""
    rows = [("a", 1, 0, i, [i - 1] if i else [], f"s{i}") for i in range(20)] * 2  # a chain, every row twice
    rows += [("a", 2, 0, i, [(i + 1) % 5], f"c{i}") for i in range(5)]  # a circle
    rows += [("a", 3, 0, 9, [8], "top"), ("a", 3, 0, 8, [7, 6], "fork"), ("a", 3, 0, 7, [], "x"), ("a", 3, 0, 6, [], "y")]
    rows += [("a", 4, 0, 3, [1], "outside"), ("b", 4, 0, 1, [], "other application")]
    rows += [("a", 5, 0, 3, [1], "jump"), ("a", 5, 0, 1, [2], "up"), ("a", 5, 0, 2, None, "end")]
    rows += [("a", 6, 0, 8, [3], "tail"), ("a", 6, 0, 3, [2], "c3"), ("a", 6, 0, 2, [3], "c2")]  # a way into a circle
    found = lineage.stage_callsites(spark.createDataFrame(rows, RDDS), in_row).collect()
    sites = {(r["app_id"], r["stage_id"]): (r["rdd_id"], r["callsite"]) for r in found}
    assert sites.pop(("a", 2))[1] in {f"c{i}" for i in range(5)} and sites.pop(("a", 6))[1] in ("c2", "c3")
    assert sites == {
        ("a", 1): (0, "s0"), ("a", 3): (8, "fork"), ("a", 4): (3, "outside"), ("b", 4): (1, "other application"),
        ("a", 5): (2, "end"),
    }
    assert len(found) == 7 and lineage.stage_callsites(spark.createDataFrame([], RDDS), in_row).isEmpty()


def test_call_site_of_a_long_chain(spark):
    """100,000 RDDs in one stage, in an order that does not follow their ids, beside a small stage."""
    n = 100_000
    chain = spark.range(n).selectExpr(
        "'a' AS app_id", "1 AS stage_id", "0 AS stage_attempt_id", f"(id * 7919) % {n} AS rdd_id",
        f"if(id = 0, array(), array(((id - 1) * 7919) % {n})) AS parent_ids", "concat('s', id) AS callsite",
    )
    small = spark.createDataFrame([("a", 2, 0, 1, [], "one")], RDDS)
    found = {r["stage_id"]: r["callsite"] for r in lineage.stage_callsites(chain.unionByName(small)).collect()}
    assert found == {1: "s0", 2: "one"}
