"""Hot keys: the ways that never gather a key give the same results as the plain ones."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.fixtures import EVAL_MS
from jobscope.operators import lineage, stages
from jobscope.operators.skew import exact_ranks, hot_keys, running_total, split_hot
from jobscope.schemas import STAGE_KEYS, STAGE_RDDS
from jobscope.session import scratch_path


def rows(df):
    return sorted(map(str, df.collect()))


def test_hot_stages_have_the_same_statistics(tables):
    plain = stages.stage_stats(tables.tasks, EVAL_MS, hot_rows=None)
    # At this limit some stages are hot and some are not; at 1 all of them are.
    counts = [r["n"] for r in tables.tasks.groupBy("stage_id").agg(F.count("*").alias("n")).collect()]
    middle = sorted(counts)[len(counts) // 2]
    expected = rows(plain)
    for limit in (middle, 1):
        assert rows(stages.stage_stats(tables.tasks, EVAL_MS, hot_rows=limit)) == expected


def test_approximate_statistics_keep_maxima_and_come_close(tables):
    exact = stages.stage_stats(tables.tasks, EVAL_MS, hot_rows=None)
    close = stages.stage_stats(tables.tasks, EVAL_MS, accuracy=10_000)
    same = [c for c in exact.columns if c.endswith(("_max", "_task_id", "_bytes", "_running")) or c == "input_mid"]
    assert rows(exact.select(*STAGE_KEYS, *same)) == rows(close.select(*STAGE_KEYS, *same))
    # With this accuracy the rank is right; only the interpolation between two values is missing.
    near = exact.alias("e").join(close.alias("c"), STAGE_KEYS)
    apart = near.filter("abs(e.time_mid - c.time_mid) > 0.2 * e.time_mid + 5000")
    assert apart.isEmpty()
    assert near.filter("e.run_five[0] <> c.run_five[0] OR e.run_five[4] <> c.run_five[4]").isEmpty()


def test_hot_keys_by_count_and_both_joins(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 100).alias("k"), "id")
    assert [r["k"] for r in hot_keys(df, ["k"], 100).collect()] == [0]
    assert split_hot(df, ["k"], 407)[1] is None and split_hot(df, ["k"], None)[1] is None
    for most in (0, 10):
        ordinary, hot = split_hot(df, ["k"], 100, max_broadcast=most)
        assert (ordinary.count(), hot.count()) == (594, 406)
        plan = hot._jdf.queryExecution().analyzed().toString()
        assert ("ResolvedHint" in plan) == (most > 0)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-(10**12), 10**12) | st.integers(-3, 3), min_size=1, max_size=60))
def test_exact_ranks_equal_sorting(spark, numbers):
    df = spark.createDataFrame([("a", v) for v in numbers], "k string, m bigint")
    found = exact_ranks(df, ["k"], ["m"], "array(0L, bigint(floor(n / 2)), n - 1)").collect()
    ordered, n = sorted(numbers), len(numbers)
    assert {(r["rank"], r["value"]) for r in found} == {(i, ordered[i]) for i in (0, n // 2, n - 1)}


def test_running_total_equals_one_window(spark):
    random.seed(5)
    data = [(random.choice("aab"), t, random.randint(0, 1)) for t in random.sample(range(100_000), 500)]
    df = spark.createDataFrame(data, "k string, t bigint, v int")
    sliced = running_total(df, ["k"], ["t div 1000"], ["t"], "v", "total")
    whole = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(sliced) == rows(df.withColumn("total", F.sum("v").over(whole)))


def brute_callsite(rdds):
    """Walk of one stage: ``{rdd: parents}`` to the RDD where it stops."""
    at = max(rdds)
    while len(rdds[at]) == 1 and rdds[at][0] in rdds:
        at = rdds[at][0]
    return at


def test_callsites_of_random_lineages(spark):
    random.seed(9)
    data, expected = [], {}
    for stage in range(30):
        ids = sorted(random.sample(range(200), random.randint(1, 60)))
        graph = {}
        for i, rdd in enumerate(ids):
            kind = random.random()
            lower = ids[:i]
            if not lower or kind < 0.05:
                graph[rdd] = []
            elif kind < 0.1:
                graph[rdd] = [1000]
            elif kind < 0.15:
                graph[rdd] = [random.choice(lower), random.choice(lower)]
            else:
                graph[rdd] = [lower[-1]] if kind < 0.8 else [random.choice(lower)]
        expected[stage] = brute_callsite(graph)
        data += [("a", stage, 0, rdd, parents, f"site {rdd}") for rdd, parents in graph.items()]
    df = spark.createDataFrame(data, STAGE_RDDS)
    found = lineage.stage_callsites(df).collect()
    assert {r["stage_id"]: r["rdd_id"] for r in found} == expected
    assert all(r["callsite"] == f"site {r['rdd_id']}" for r in found)


def test_links_to_higher_ids_and_circles(spark):
    graphs = {1: {5: [2], 2: [4], 4: [3], 3: []}, 2: {7: [6], 6: [7]}, 3: {9: [9]}, 4: {8: [3], 3: [5], 5: [4], 4: [3]}}
    data = [("a", s, 0, rdd, parents, f"site {rdd}") for s, graph in graphs.items() for rdd, parents in graph.items()]
    found = {r["stage_id"]: r["rdd_id"] for r in lineage.stage_callsites(spark.createDataFrame(data, STAGE_RDDS)).collect()}
    assert found[1] == 3 and found[2] in (6, 7) and found[3] == 9 and found[4] in (3, 4, 5)


def test_long_chain(spark):
    df = spark.range(5000).select(
        F.lit("a").alias("app_id"), F.lit(1).alias("stage_id"), F.lit(0).alias("stage_attempt_id"),
        F.col("id").alias("rdd_id"), F.when(F.col("id") > 17, F.array(F.col("id") - 1)).alias("parent_ids"),
        F.col("id").cast("string").alias("callsite"),
    )
    assert lineage.stage_callsites(df).first()["rdd_id"] == 17


def test_intermediate_tables_lie_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")
