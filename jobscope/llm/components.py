"""Connected components of links, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _between_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` with both ends replaced by their roots, as distinct (``low``, ``high``) without self-links."""
    one = roots.select(F.col("node").alias("low"), F.col("root").alias("low_root"))
    two = roots.select(F.col("node").alias("high"), F.col("root").alias("high_root"))
    ends = links.join(one, "low", "left").join(two, "high", "left").select(F.coalesce("low_root", "low").alias("p"), F.coalesce("high_root", "high").alias("q"))
    return ends.where("p != q").select(F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")).distinct()


def _flat(hooks: DataFrame) -> DataFrame:
    """``hooks`` (``node``, ``root``) with every root replaced by the end of its path; paths halve each time."""
    while True:
        up = hooks.select(F.col("node").alias("via"), F.col("root").alias("far"))
        jumped = materialise(
            hooks.join(up, F.col("root") == F.col("via"), "left")
            .select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "hooks"
        )
        if jumped.where("moved").isEmpty():
            return hooks
        hooks = jumped.select("node", "root")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of ``links`` (``a``, ``b``).

    Each round every root that is linked to a smaller one hooks to the smallest of them, paths of hooks are flattened,
    and links between roots are all that the next round sees.  Where labels are in no order (digests), a round leaves a third of
    a chain's roots; a chain in order is one round.  Rounds are written tables in the shared folder, so lineage stays
    short.  Self-links and repeated links do no harm; an empty table gives an empty result.
    """
    ends = links.select("a", "b")
    left = materialise(
        ends.where("a != b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "links"
    )
    nodes = ends.select(F.col("a").alias("node")).union(ends.select(F.col("b").alias("node"))).distinct()
    state = nodes.select("node", F.col("node").alias("root"))
    while not left.isEmpty():
        hooks = _flat(materialise(left.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")), "hooks"))
        up = hooks.select(F.col("node").alias("via"), F.col("root").alias("far"))
        state = materialise(state.join(up, F.col("root") == F.col("via"), "left").select("node", F.coalesce("far", "root").alias("root")), "roots")
        left = materialise(_between_roots(left, hooks), "links")
    return state


def joined_components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (``node``, ``root``) with further ``links``: only links between different classes are worked on.

    Ends of links that are in no class yet are classes of their own.
    """
    low_high = links.select(F.col("a").alias("low"), F.col("b").alias("high"))
    merged = components(_between_roots(low_high, classes).select(F.col("low").alias("a"), F.col("high").alias("b")))
    up = merged.select(F.col("node").alias("via"), F.col("root").alias("far"))
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    every = classes.unionByName(ends.join(classes, "node", "left_anti").select("node", F.col("node").alias("root")))
    return every.join(up, F.col("root") == F.col("via"), "left").select("node", F.coalesce("far", "root").alias("root"))
