"""Merkle manifest of a dataset as a content-addressed DAG.

Leaves are ranked per group, runs of FAN_OUT consecutive nodes become records (digest of a node, digests of its
children), level by level.  Proofs come from descent alone: requests for leaves start at the root, look each digest up
among the records, follow the digits of their rank, collect the children they pass by, and reverse what they collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .tables import read

FAN_OUT = 16
# Characters of a digest in hex.
WIDE = 64
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# monotonically_increasing_id holds the partition above this bit.
PARTITION_BIT = 33
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "CAST(array() AS array<struct<before:string,after:string>>)"


def leaf_digest(*fields: Column) -> Column:
    """Digest of a row: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _ranked(leaves: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0) and ``n`` (leaves) within each ``tree``, by ``at``, ``digest`` and ``tie``.

    Rows are dealt by ranges of that whole order, so a tree of any size, and any number of equal rows, spread over many
    tasks; positions inside a range and counts of ranges give the rank.
    """
    order = ["tree", "at", "digest", "tie"]
    placed = materialise(
        leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("position", F.monotonically_increasing_id()),
        "merkle-placed",
    ).withColumn("part", F.shiftright("position", PARTITION_BIT))
    tree = Window.partitionBy("tree")
    runs = placed.groupBy("tree", "part").agg(F.min("position").alias("first"), F.count("*").alias("here")).select(
        "tree", "part", "first",
        (F.sum("here").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("before"),
        F.sum("here").over(tree).alias("n"),
    )
    return placed.join(runs, ["tree", "part"]).withColumn("rank", F.col("position") - F.col("first") + F.col("before")).drop(
        "position", "part", "first", "before", "tie", "at"
    )


@dataclass(frozen=True)
class Forest:
    """Trees over ranked leaves (``tree``, ``rank``, ``n``, ``digest`` and ``ask``, whatever a leaf carries).

    ``records[h]`` holds ``digest`` and ``children`` of the nodes of height h, each digest once, ``roots`` one row
    per tree: ``tree``, ``height``, ``digest``.
    """

    leaves: DataFrame
    records: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame) -> Forest:
    """Builds the trees of ``leaves`` (``tree``, ``at``, ``digest``, ``tie``, ``ask``).

    While a tree has several nodes on a level, every FAN_OUT consecutive ones, the last run fewer, become a node whose
    digest is that of their digests in a row.  A lone leaf is its own root.
    """
    ranked = materialise(_ranked(leaves), "merkle-leaves")
    most = ranked.agg(F.max("n")).first()[0] or 0
    level, width, height, records, roots = ranked, F.col("n"), 0, [None], []
    while True:
        roots.append(level.where(width == 1).select("tree", F.lit(height).alias("height"), "digest"))
        if most <= FAN_OUT**height:
            break
        height += 1
        nodes = (
            level.where(width > 1).groupBy("tree", "n", F.floor(F.col("rank") / FAN_OUT).alias("node"))
            .agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run"))
            .select("tree", "n", F.col("node").alias("rank"), F.array_join(F.col("run.digest"), "").alias("children"))
            .withColumn("digest", F.sha2("children", 256))
        )
        level = materialise(nodes, "merkle-level")
        width = F.ceil(F.col("n") / F.lit(FAN_OUT**height))
        records.append(level.select("digest", "children").distinct())
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return Forest(ranked, records, materialise(found, "merkle-roots"))


def _sides(children: str, place: str) -> str:
    """SQL of the children beside the one at ``place``, as digests in a row before and after it."""
    return (
        f"named_struct('before', substr({children}, 1, int({place}) * {WIDE}), "
        f"'after', substr({children}, (int({place}) + 1) * {WIDE} + 1))"
    )


def _child(children: str, place: str) -> str:
    return f"substr({children}, int({place}) * {WIDE} + 1, {WIDE})"


def descend(records: list[DataFrame], starts: DataFrame, asked: DataFrame) -> DataFrame:
    """``tree``, ``rank``, ``digest`` (the leaf), ``home`` (the digest started from), ``path`` and ``ask`` of each request.

    ``starts`` has ``tree``, ``height``, ``digest`` and ``path`` (what was collected above), ``asked`` has ``tree``,
    ``rank`` and ``ask``, each leaf once.  Requests below the same node move as one row until they part, so a node is looked
    up once however many leaves are asked, and the rows of a step are at most the nodes of its level.  The path lists
    the children passed by from the root down.
    """
    runs = materialise(
        asked.groupBy("tree", F.floor(F.col("rank") / FAN_OUT).alias("node")).agg(F.collect_list(F.struct("rank", "ask")).alias("asks")),
        "merkle-asked",
    )
    wanted = {1: runs.select("tree", "node")}
    for height in range(2, len(records)):
        wanted[height] = wanted[height - 1].select("tree", F.floor(F.col("node") / FAN_OUT).alias("node")).distinct()
    homes = starts.select("tree", "height", F.lit(0).cast("bigint").alias("node"), "digest", F.col("digest").alias("home"), "path")
    state = None
    for height in range(len(records) - 1, 0, -1):
        here = homes.where(F.col("height") == height).drop("height").join(wanted[height], ["tree", "node"], "left_semi")
        state = here if state is None else state.unionByName(here)
        known = state.join(records[height], "digest")
        if height > 1:
            parted = known.select("*", F.explode(F.expr(f"sequence(0, length(children) div {WIDE} - 1)")).alias("place")).selectExpr(
                "tree", f"node * {FAN_OUT} + place AS node", f"{_child('children', 'place')} AS digest", "home",
                f"array_append(path, {_sides('children', 'place')}) AS path",
            )
            state = parted.join(wanted[height - 1], ["tree", "node"], "left_semi")
    lone = homes.where("height = 0").join(runs, ["tree", "node"]).select("tree", "digest", "home", "path", F.inline("asks")).select(
        "tree", "rank", "digest", "home", "path", "ask"
    )
    if state is None:
        return lone
    leaves = known.drop("digest").join(runs, ["tree", "node"]).select("tree", "home", "path", "children", F.inline("asks")).selectExpr(
        "tree", "rank", f"{_child('children', f'rank % {FAN_OUT}')} AS digest", "home",
        f"array_append(path, {_sides('children', f'rank % {FAN_OUT}')}) AS path", "ask",
    )
    return leaves.unionByName(lone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path, from the root down, lead to."""
    return F.aggregate(
        F.reverse(path), leaf, lambda digest, side: F.sha2(F.concat(side["before"], digest, side["after"]), 256)
    )


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(F.reverse(path), lambda side: F.concat(side["before"], side["after"])), ""), 256)


def manifest(
    rows: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id",
    tampered: dict[str, Column] | None = None, where: Column | None = None,
) -> DataFrame:
    """One row per row of ``rows``: the ``order`` column, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``
    and ``verified``.

    A leaf digests ``fields``; leaves of a ``group`` ascend by ``order``, groups by their UTF-8 bytes; nulls come first in
    both.  Equal ids are ordered by digest; repeated rows are leaves of their own.  ``tampered`` replaces fields in the rows
    ``where`` holds: only ``folded_root`` (what the changed leaf and the original siblings lead to) and ``verified``
    (it equals the root) see it.  Other columns are not read.  An empty table gives an empty result.
    """
    spark = rows.sparkSession
    own = F.struct(*[F.col(f"`{name}`").alias(name) for name in dict.fromkeys((*fields, group, order))])
    row = rows.select(own.alias("row"))
    changed = F.lit(None).cast("string")
    if tampered:
        seen = [tampered[f] if f in tampered else F.col("row")[f] for f in fields]
        changed = F.when(where, leaf_digest(*seen))
    name = F.col("row")[group].cast("string")
    leaves = materialise(
        row.select(
            F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("tree"), F.col("row")[order].alias("at"),
            leaf_digest(*[F.col("row")[f] for f in fields]).alias("digest"), F.monotonically_increasing_id().alias("tie"),
            F.struct(F.col("row")[order].alias("id"), changed.alias("changed")).alias("ask"),
        ),
        "merkle-digests",
    )
    trees = grow(leaves)
    subroots = trees.roots.select(
        F.lit("").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(0).cast("bigint").alias("tie"),
        F.struct("tree", "height", "digest").alias("ask"),
    )
    top = grow(subroots)
    root = top.roots.first()
    if root is None:
        root = {"digest": None}
    above = descend(top.records, top.roots.withColumn("path", F.expr(NO_PATH)), top.leaves.select("tree", "rank", "ask"))
    starts = materialise(above.select("ask.tree", "ask.height", "ask.digest", "path"), "merkle-subroots")
    found = descend(trees.records, starts, trees.leaves.select("tree", "rank", "ask"))
    folded = found.select(
        F.col("ask.id").alias(order), F.col("digest").alias("leaf"), F.col("home").alias("subroot"),
        F.lit(root["digest"]).cast("string").alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("ask.changed", "digest"), F.col("path")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf, its proof's digest, and whether it verifies once the A-Z of some texts are lower-cased."""
    chosen = F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("row.text", UPPER, UPPER.lower())
    return manifest(read(spark, sf_dir, "documents"), tampered={"text": lowered}, where=chosen)


def _sql(levels: int = 7) -> str:
    """Trees of up to FAN_OUT**levels leaves a group, each level and its siblings by window functions."""
    field = lambda f: f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode(CAST({f} AS VARCHAR))) || ':' || {f} END"
    lowered = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    leaf = " || ".join(map(field, FIELDS))
    changed = " || ".join([*map(field, FIELDS[:-1]), field(lowered)])
    bits = "flatten([[ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1] for ch in string_split(CAST(doc_id AS VARCHAR), '')])"
    crc = (
        f"xor(list_reduce(list_prepend(4294967295, {bits}), "
        "lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    )
    parts = [
        f"""d AS (SELECT doc_id, source, sha256({leaf}) AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN sha256({changed}) END AS changed FROM documents)""",
        """s0 AS (SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
  leaf AS g, doc_id, leaf, changed, count(*) OVER (PARTITION BY source) AS n FROM d)""",
    ]

    def climb(name: str, extra: str) -> None:
        """Levels 1… of trees ``tree``: ``name``h has rank and digest of each node; beside it the sides of its children."""
        for h in range(levels):
            run = f"PARTITION BY tree, r // {FAN_OUT} ORDER BY r ROWS BETWEEN"
            parts.append(
                f"""{name}w{h} AS (SELECT tree, r, g, n, count(*) OVER (PARTITION BY tree) = 1 AS alone,
  coalesce(string_agg(g, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(g, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{h})"""
            )
            parts.append(
                f"""{name}{h + 1} AS (SELECT tree, r // {FAN_OUT} AS r, any_value(n) AS n,
  CASE WHEN any_value(alone) THEN any_value(g) ELSE sha256(string_agg(g, '' ORDER BY r)) END AS g FROM {name}w{h} GROUP BY tree, r // {FAN_OUT})"""
            )

    climb("s", "")
    parts.append(
        f"""t0 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS r, g, tree AS source, 0 AS n FROM s{levels})"""
    )
    climb("t", "")
    parts.append(f"f0 AS (SELECT l.*, '' AS p, coalesce(changed, leaf) AS f FROM s0 l)")
    for h in range(levels):
        parts.append(
            f"""f{h + 1} AS (SELECT f.* REPLACE (CASE WHEN w.alone THEN p ELSE p || w.b || w.a END AS p, CASE WHEN w.alone THEN f ELSE sha256(w.b || f || w.a) END AS f)
  FROM f{h} f JOIN sw{h} w ON w.tree IS NOT DISTINCT FROM f.tree AND w.r = f.r // {FAN_OUT**h})"""
        )
    parts.append(
        f"""u0 AS (SELECT f.doc_id, f.leaf, f.p, f.f, t.r, t.g AS subroot FROM f{levels} f JOIN t0 t ON t.source IS NOT DISTINCT FROM f.tree)"""
    )
    for h in range(levels):
        parts.append(
            f"""u{h + 1} AS (SELECT u.* REPLACE (CASE WHEN w.alone THEN p ELSE p || w.b || w.a END AS p, CASE WHEN w.alone THEN f ELSE sha256(w.b || f || w.a) END AS f)
  FROM u{h} u JOIN tw{h} w ON w.r = u.r // {FAN_OUT**h})"""
        )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT u.doc_id, u.leaf, u.subroot, t.g AS root, sha256(u.p) AS proof_sha256, u.f AS folded_root, u.f = t.g AS verified
FROM u{levels} u CROSS JOIN t{levels} t"""
    )


OP11_SQL = _sql()
