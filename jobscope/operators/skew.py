"""Hot keys: finding them, exact order statistics and running totals that survive them.

One key may hold a large share of all rows.  Plain aggregates are safe, since they are combined
before the shuffle.  What is not safe is anything that gathers the values of a key in one task:
exact percentiles, sorted lists, running windows.  The functions here do those by key *slices*
whose size does not follow the size of the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from ..settings import HOT_ROWS, MAX_BROADCAST_KEYS


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``hot_rows`` rows.  Only the key columns are read."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= hot_rows).select(*keys)


def split_hot(
    df: DataFrame,
    keys: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
    counted: DataFrame | None = None,
    max_broadcast: int = MAX_BROADCAST_KEYS,
) -> tuple[DataFrame, DataFrame | None]:
    """``(rows of ordinary keys, rows of hot keys)``; the second is None when no key is hot.

    Hot keys are looked up at once, by one count over the key columns (of ``counted``, where that is
    a cheaper table with the same rows per key).  So the usual plan stays a single aggregation.  Hot
    keys, where there are any, are written and counted: up to ``max_broadcast`` of them are
    broadcast, more are joined by a shuffle, in which Spark may split a key.  ``hot_rows=None`` skips
    the look-up where groups are known to be small.
    """
    if hot_rows is None:
        return df, None
    found = hot_keys(df if counted is None else counted, keys, hot_rows)
    if found.isEmpty():
        return df, None
    hot = materialise(found, "hot-keys")
    if hot.count() <= max_broadcast:
        hot = F.broadcast(hot)
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi")


def exact_ranks(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], ranks: str) -> DataFrame:
    """Values at given ranks of each metric within each key, exact for keys of any size.

    ``ranks`` is SQL for an array of 0-based ranks over ``n``, the number of non-null values.
    Returns ``(keys, metric, n, rank, value)``.  Values are counted first, so equal values collapse
    before the shuffle.  A value lies in the cell ``floor(sqrt(value))``: running counts over cells
    find the cell of each rank, running counts inside that cell find the value.  Both windows see
    O(sqrt(max value)) rows, never all rows of a key.
    """
    keys = list(keys)
    pairs = ", ".join(f"struct('{m}' AS metric, bigint({m}) AS value)" for m in metrics)
    counts = (
        df.selectExpr(*keys, f"inline(array({pairs}))")
        .filter("value IS NOT NULL")
        .groupBy(*keys, "metric", "value")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("cell", F.expr("bigint(signum(value) * floor(sqrt(abs(value))))"))
    )
    whole = Window.partitionBy(*keys, "metric")
    upto = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = (
        counts.groupBy(*keys, "metric", "cell")
        .agg(F.sum("c").alias("cell_n"))
        .select("*", F.sum("cell_n").over(upto).alias("cell_upto"), F.sum("cell_n").over(whole).alias("n"))
        .selectExpr(*keys, "metric", "cell", "n", "cell_upto", "cell_upto - cell_n AS cell_before",
                    f"explode(array_distinct({ranks})) AS rank")
        .filter("rank >= cell_before AND rank < cell_upto")
        .drop("cell_upto")
    )
    inside = (
        Window.partitionBy(*keys, "metric", "cell", "rank")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        counts.join(wanted, [*keys, "metric", "cell"])
        .withColumn("upto", F.col("cell_before") + F.sum("c").over(inside))
        .filter("rank < upto AND rank >= upto - c")
        .select(*keys, "metric", "n", "rank", "value")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Sequence[str],
    order_by: Sequence[str],
    value: str,
    out: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` per key, in the order ``(slice_by, order_by)``.

    ``slice_by`` (SQL) cuts a key into consecutive slices, each of a size the caller can bound.  Rows
    are shuffled by key and slice; only slice totals (combined before their shuffle) are brought
    together per key.  The totals come back by a join on the partitioning the rows already have.
    """
    keys = list(keys)
    names = [f"_slice{i}" for i in range(len(slice_by))]
    sliced = df.selectExpr("*", *[f"{c} AS {n}" for c, n in zip(slice_by, names)], f"bigint({value}) AS _v")
    inside = (
        Window.partitionBy(*keys, *names)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*keys, *names)
        .agg(F.sum("_v").alias("_total"))
        .select(*keys, *names, F.sum("_total").over(before).alias("_before"))
    )
    return (
        sliced.withColumn("_inside", F.sum("_v").over(inside))
        .join(carried, [*keys, *names], "left")
        .selectExpr(*df.columns, f"_inside + coalesce(_before, 0L) AS {out}")
    )
