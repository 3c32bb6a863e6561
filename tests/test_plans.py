"""What the physical plans must and must not contain."""

import re

import pytest

from checks.fixtures import EVAL_MS, Tables
from checks.queries import QUERIES
from jobscope.operators import stages, tasks
from jobscope.operators.rules import describe, one_rule


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(tables):
    text = plan(tasks.top_tasks(tables.tasks, EVAL_MS, 3))
    assert text.count("WindowGroupLimit") == 2


def test_lost_executors_are_cut_before_the_shuffle(spark, sf_dir):
    assert plan(QUERIES["diag_executor_lost"](spark, sf_dir)).count("WindowGroupLimit") == 2


@pytest.fixture(scope="module")
def task_table(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tasks"))
    tables.tasks.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(task_table):
    text = plan(tasks.failed_attempts(task_table).select("task_id"))
    assert "In(status, [FAILED,KILLED])" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {part.split(":")[0] for part in schema.split(",")} == {"task_id", "status"}


def test_one_rule_reads_only_its_metrics(task_table, tables):
    stats = stages.stage_stats(task_table, EVAL_MS)
    text = plan(one_rule(describe(stats, tables.stages), "long_tail", EVAL_MS))
    scan = next(line for line in text.splitlines() if "shuffle_write" not in line and "FileScan parquet" in line and "duration_ms" in line)
    assert "shuffle_read_records" not in scan and "gc_ms" not in scan


def test_statistics_take_one_shuffle(task_table):
    assert plan(stages.stage_stats(task_table, EVAL_MS)).count("Exchange") == 1


def test_plain_statistics_equal_the_whole_ones_and_run_no_job(spark, task_table, tables):
    spark.sparkContext.setJobGroup("plain", "plain")
    stats = stages.plain_stats(task_table, EVAL_MS)
    views = [stages.argmax_tasks(stats), stages.running_bytes(stats), one_rule(describe(stats, tables.stages), "gc_overhead", EVAL_MS)]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plain")
    text = plan(stats)
    assert text.count("Exchange") == 1 and "collect_list" not in text and "Percentile" not in text
    whole = stages.stage_stats(task_table, EVAL_MS)
    assert sorted(map(str, stats.collect())) == sorted(map(str, whole.select(stats.columns).collect()))
    expected = [stages.argmax_tasks(whole), stages.running_bytes(whole), one_rule(describe(whole, tables.stages), "gc_overhead", EVAL_MS)]
    for ours, theirs in zip(views, expected):
        assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))


def test_views_read_only_what_they_need(spark, sf_dir):
    text = plan(Tables(spark, sf_dir).samples)
    assert "props" not in re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
