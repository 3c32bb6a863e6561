"""Every registered query against its SQL (and without cross products or Python in its plan), and the fixture counts that guard against empty fixtures."""

import pytest

from checks.compare import difference
from checks.oracles import oracle_sql
from checks.queries import QUERIES

SQL = oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "InPandas" not in plan
    assert difference(df, duck, SQL[name]) is None


@pytest.mark.parametrize(
    ("name", "rows"),
    [
        ("diag_long_tail", 17), ("diag_shuffle_read_skew", 10), ("diag_shuffle_write_skew", 12),
        ("diag_input_skew", 10), ("diag_gc_overhead", 9), ("diag_scheduler_delay", 8),
        ("diag_shuffle_read_notice", 28), ("diag_heap_pressure", 2), ("diag_executor_lost", 10),
        ("gate_half_finished", 15), ("stage_summary", 18), ("stage_rdd_callsite", 48),
    ],
)
def test_expected_counts(duck, sf_dir, name, rows):
    if not sf_dir.rstrip("/").endswith("sf0.001"):
        pytest.skip("counts are those of the smallest test directory")
    assert len(duck.execute(SQL[name]).fetchall()) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns[:3] == ["app_id", "event", "level"]
    assert df.count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
