"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, and verified by weighted
Jaccard similarity.

A shingle is five words (letters and digits, lower case); a shorter text is one shingle.  Its weight is its count in the
text times its inverse document frequency.  Document frequencies of all documents are held in CELLS counters, a bound
that does not depend on the corpus: rare shingles share cells alike, frequent ones stand out of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from . import words as W
from .components import components, joined_components
from .tables import read

SIZE = 5
SIMILARITY = 0.8
# At 0.8 a pair shares a band with probability 1 - (1 - 0.8**4)**12 = 0.998.
BANDS, ROWS = 12, 4
CELLS = 1 << 18
# How much more a shingle of one document weighs than one of all.  A full inverse frequency would push a class apart by
# its own size: where a third of all documents are near copies, what they share weighs next to nothing.
LEAN = 0.1
# Members of a bucket of several classes are compared in pairs of blocks of about so many members.
BLOCK = 1024
# Pairs whose samples agree less often than similarity less DEVIATIONS standard deviations are not verified.
DEVIATIONS = 4

_TABLE = 1 << 14
_ROW = np.uint64(0x9E3779B97F4A7C15)


def _draws() -> tuple[np.ndarray, np.ndarray]:
    """The sampling's random numbers: of each table entry 1/r, beta, r, and ln c - r + r beta; an odd factor per hash."""
    rng = np.random.default_rng(91)
    r, c, beta = rng.gamma(2.0, 1.0, _TABLE), rng.gamma(2.0, 1.0, _TABLE), rng.random(_TABLE)
    table = np.stack([1 / r, beta, r, np.log(c) - r + r * beta], axis=1).astype(np.float32)
    return table, rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_DRAWS, _FACTORS = _draws()


def shingles(piece: W.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row in row order: row, hash, count."""
    found = W.words(W.fold(piece), W.LETTERS_DIGITS)
    row = found.row()
    inside = W.window_rows(found, SIZE)
    key = [W.windows(found.hash, SIZE)[inside]]
    at = [row[: len(inside)][inside]]
    counts = np.diff(found.first)
    for n in range(1, SIZE):  # rows of fewer words
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for j in range(n):
                whole = W.mix(whole * np.uint64(3) + found.hash[found.first[short] + j])
            key.append(whole)
            at.append(short)
    key, at = np.concatenate(key), np.concatenate(at).astype(np.int64)
    order = np.lexsort((key, at))
    key, at = key[order], at[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    place = np.flatnonzero(fresh)
    return at[place], key[place], np.diff(np.append(place, len(key)))


def _cell(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(40)).astype(np.int64) % CELLS


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """1 + LEAN * ln(1 + N / df) / ln(1 + N) per cell over all rows of the one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, dtype=np.int64)
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for piece in W.pieces(batch.column(0)):
                counts += np.bincount(_cell(shingles(piece)[1]), minlength=CELLS)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(counts[some], rows))], names=["cell", "n"])

    total = texts.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    df = np.ones(CELLS)
    cells = total[total["cell"] >= 0]
    df[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    n = int(total.loc[total["cell"] < 0, "n"].sum())
    return (1 + LEAN * np.log1p(max(n, 1) / df) / np.log1p(max(n, 1))).astype(np.float32)


def samples(piece: W.Piece, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a shingle, and the BANDS * ROWS samples of each.

    Sample j of a row is the shingle (and its level t) with the least ln a = ln c - r (t - beta) - r, where t is
    floor(ln S / r + beta): two rows agree with the probability of their weighted Jaccard similarity.
    """
    row, key, count = shingles(piece)
    if not len(key):
        return np.zeros(0, np.int64), np.zeros((0, BANDS * ROWS), np.uint64)
    log_weight = np.log(count * idf[_cell(key)]).astype(np.float32)
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = row[1:] != row[:-1]
    first = np.flatnonzero(fresh)
    sizes = np.diff(np.append(first, len(row)))
    out = np.empty((len(first), BANDS * ROWS), dtype=np.uint64)
    for j in range(BANDS * ROWS):
        drawn = _DRAWS[(key * _FACTORS[j]) >> np.uint64(50)]
        level = np.floor(log_weight * drawn[:, 0] + drawn[:, 1])
        value = drawn[:, 3] - drawn[:, 2] * level
        least = np.minimum.reduceat(value, first)
        hit = np.flatnonzero(value == np.repeat(least, sizes))
        sample = W.mix(key[hit] * np.uint64(5) + level[hit].astype(np.int64).astype(np.uint64))
        out[:, j] = np.minimum.reduceat(sample, np.searchsorted(hit, first))
    return row[first], out


def _keys(drawn: np.ndarray) -> np.ndarray:
    out = np.empty((len(drawn), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        whole = np.full(len(drawn), band + 1, dtype=np.uint64)
        for j in range(band * ROWS, (band + 1) * ROWS):
            whole = W.mix(whole * np.uint64(31) + drawn[:, j])
        out[:, band] = whole
    return out


def band_keys(piece: W.Piece, idf: np.ndarray) -> np.ndarray:
    """BANDS hashes per row, each of ROWS samples; rows without a shingle have zeros."""
    present, drawn = samples(piece, idf)
    out = np.zeros((piece.n, BANDS), dtype=np.uint64)
    out[present] = _keys(drawn)
    return out


def weighted_jaccard(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Exact similarity of each pair of texts; two texts without shingles have 0."""
    out = np.zeros(len(left))
    for i in range(0, len(left), 64):
        sides = []
        for column in (left, right):
            rows, keys, weights = [], [], []
            for piece in W.pieces(column.slice(i, 64)):
                row, key, count = shingles(piece)
                rows.append(row + piece.first)
                keys.append(key)
                weights.append(count * idf[_cell(key)].astype(np.float64))
            row, key = np.concatenate(rows), np.concatenate(keys)
            sides.append((row, W.mix(key + row.astype(np.uint64) * _ROW), np.concatenate(weights)))
        (row_a, key_a, w_a), (row_b, key_b, w_b) = sides
        _, at_a, at_b = np.intersect1d(key_a, key_b, return_indices=True)
        n = len(left.slice(i, 64))
        shared = np.bincount(row_a[at_a], np.minimum(w_a[at_a], w_b[at_b]), n)
        union = np.bincount(row_a, w_a, n) + np.bincount(row_b, w_b, n) - shared
        out[i : i + n] = shared / np.maximum(union, 1e-12)
    return out


def _bytes(column: pa.Array, size: int) -> np.ndarray:
    """A binary column, all of one size, as rows of bytes."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + size * len(column)].reshape(-1, size)


def _least(similarity: float) -> int:
    """How many samples of a pair must agree at least for it to be verified."""
    n = BANDS * ROWS
    return int(n * similarity - DEVIATIONS * (n * similarity * (1 - similarity)) ** 0.5)


def _alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (``a``, ``b``) whose samples (``of_a``, ``of_b``) agree often enough; no text is moved for it."""
    n, least = BANDS * ROWS, _least(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_bytes(batch.column(2), n) == _bytes(batch.column(3), n)).sum(axis=1)
                some = pa.array(same >= least)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(some) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose texts are similar enough."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = weighted_jaccard(batch.column(2), batch.column(3), idf) >= similarity
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in (0, 1)], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _node(text) -> "F.Column":
    """128 bits of the text's digest; null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def text_classes(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``node`` and ``root`` of every distinct text (``node``, ``text``) that is linked to another.

    In each bucket all members are compared with one centre, so a bucket of n texts gives n pairs, not n squared.  Where
    that leaves a bucket with more than one class, every two members of different classes are compared too, block by
    block, until they are in one class: no pair that shares a bucket is left out.
    Comparisons are of samples first; only pairs whose samples agree often enough are verified by their texts.
    """
    idf = inverse_frequencies(texts.select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch.column(1)):
                present, drawn = samples(piece, idf)
                node = batch.column(0).take(pa.array(np.repeat(piece.first + present, BANDS)))
                short = (drawn >> np.uint64(56)).astype(np.uint8)
                of = pa.array([bytes(x) for x in short], pa.binary()).take(pa.array(np.repeat(np.arange(len(short)), BANDS)))
                band = np.tile(np.arange(BANDS, dtype=np.int32), len(present))
                yield pa.RecordBatch.from_arrays(
                    [node, pa.array(band), pa.array(_keys(drawn).astype(np.int64).ravel()), of], names=["node", "band", "key", "of"]
                )

    banded = texts.mapInArrow(run, "node binary, band int, key bigint, of binary").dropDuplicates(["node", "band"])
    banded = materialise(banded, "bands")
    shared = (
        banded.groupBy("band", "key").agg(F.min(F.struct("node", "of")).alias("c"), F.count("*").alias("n"))
        .where("n > 1").select("band", "key", "c")
    )
    members = materialise(banded.join(shared, ["band", "key"]).select("band", "key", "node", "of", "c"), "members")
    involved = members.select("node").distinct()
    held = materialise(texts.join(involved, "node", "left_semi").dropDuplicates(["node"]), "near-texts")
    pairs = members.where("node != c.node").selectExpr("c.node AS a", "node AS b", "c.of AS of_a", "of AS of_b")
    tried = materialise(_alike(pairs, similarity), "pairs")
    links = materialise(_verified(tried, held, idf, similarity), "near-links")
    classes = components(links)
    labelled = members.join(classes, "node", "left").select("band", "key", "node", "of", (F.col("node") == F.col("c.node")).alias("centre"), F.coalesce("root", "node").alias("root"))
    labelled = materialise(labelled, "labelled")
    # In a bucket of two the centre's pair is the only one.
    open_ = labelled.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low != high AND n > 2")
    found = materialise(_between(labelled, open_, held, idf, similarity), "near-links")
    return materialise(joined_components(classes, found), "classes") if not found.isEmpty() else classes


def _between(members: DataFrame, buckets: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """Links (``a``, ``b``) between the classes of each bucket, enough to join all classes that have one.

    A bucket is dealt into blocks of about BLOCK members; each pair of blocks is a group of its own.  Groups of samples alone
    tell which members have a partner; only those go on with their texts.
    """
    spread = buckets.select("band", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = (
        members.join(spread, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "of", "centre", "root")
    )

    def paired(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        pairs, _ = _pairs(group, similarity)
        return group.take(pa.array(np.unique(pairs[1:]), pa.int64())).cast(group.schema)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        a, b = _links(group, idf, similarity)
        node = group.column("node").combine_chunks()
        return pa.table({"a": node.take(pa.array(a, pa.int64())).cast(pa.binary()), "b": node.take(pa.array(b, pa.int64())).cast(pa.binary())})

    keys = ["band", "key", "x", "y"]
    some = materialise(placed.groupBy(*keys).applyInArrow(paired, placed.schema), "paired")
    return some.join(texts, "node").groupBy(*keys).applyInArrow(run, "a binary, b binary")


def _pairs(group: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (agreement, one, other) for members of different classes whose samples agree often enough, and the class of each row.

    ``group`` is a pair of blocks of a bucket.  Pairs with the centre were compared before.
    """
    n, least = BANDS * ROWS, _least(similarity)
    drawn = np.frombuffer(b"".join(group.column("of").to_pylist()), np.uint8).reshape(-1, n).T.copy()
    own, centre = np.asarray(group.column("own")), np.asarray(group.column("centre"))
    _, label = np.unique(np.array([x.hex() for x in group.column("root").to_pylist()]), return_inverse=True)
    x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
    left, right = np.flatnonzero((own == x) & ~centre), np.flatnonzero((own == y) & ~centre)
    pairs = [np.zeros((3, 0), np.int64)]
    for i in range(0, len(left), 64):
        part = left[i : i + 64]
        same = np.zeros((len(part), len(right)), dtype=np.uint8)
        for sample in drawn:
            same += sample[part][:, None] == sample[right][None, :]
        near = (same >= least) & (label[part][:, None] != label[right][None, :])
        if x == y:
            near &= part[:, None] < right[None, :]
        p, q = np.nonzero(near)
        pairs.append(np.stack([same[p, q].astype(np.int64), part[p], right[q]]))
    return np.concatenate(pairs, axis=1), label


def _links(group: pa.Table, idf: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Rows of ``group`` (a pair of blocks of a bucket) that are linked, until every linked class is joined.

    Pairs go by falling agreement of their samples; one whose rows are in one class by then needs no verification, any
    other is verified.
    """
    every, label = _pairs(group, similarity)
    parent = list(range(int(label.max()) + 1))

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    texts, held = group.column("text"), {}

    def weighted(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in held:
            piece = next(iter(W.pieces(pa.array([texts[k].as_py()], pa.string()))))
            _, key, count = shingles(piece)
            held[k] = key, count * idf[_cell(key)].astype(np.float64)
        return held[k]

    a, b = [], []
    for _, p, q in every[:, np.lexsort((every[2], every[1], -every[0]))].T.tolist():
        one, two = top(int(label[p])), top(int(label[q]))
        if one == two:
            continue
        (key_p, w_p), (key_q, w_q) = weighted(p), weighted(q)
        total_p, total_q = w_p.sum(), w_q.sum()
        if min(total_p, total_q) < similarity * max(total_p, total_q) - 1e-6:
            continue  # the shared weight is at most the smaller one
        _, at_p, at_q = np.intersect1d(key_p, key_q, assume_unique=True, return_indices=True)
        shared = np.minimum(w_p[at_p], w_q[at_q]).sum()
        if shared / max(total_p + total_q - shared, 1e-12) >= similarity:
            parent[one] = two
            a.append(p)
            b.append(q)
    return a, b


def _classed(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """``id``, ``node`` (the text) and ``root`` (the class) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("node", _node(F.col("text")))
    roots = text_classes(rows.select("node", "text"), similarity)
    return rows.select("id", "node").join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``id_col``, ``class_id``, ``class_size`` and ``kept`` of every row.

    Equal texts, and texts linked by a weighted Jaccard similarity of ``similarity`` or more, are one class; classes are
    the components of these links.  ``class_id`` is the smallest id of the class, whose row is kept.  Null and empty
    texts are equal, and texts without letters or digits are near none but their copies.  A null id is in the class of
    its text and kept only where the class has no other id; rows that repeat an id and text share their answer.
    """
    classed = _classed(docs, id_col, text_col, similarity)
    sizes = classed.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return classed.join(sizes, "root").select(F.col("id").alias(id_col), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest id (a null id last), then of the smallest text digest.

    Rows are dropped by id and text, so other rows of a dropped id stay.  Of rows that repeat the kept id and text, one stays.
    """
    row_key = lambda id_, node: F.concat_ws("|", F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("")), F.hex(node))
    classed = _classed(docs, id_col, text_col, similarity).select("id", "node", "root").distinct()
    place = F.struct(F.col("id").isNull().alias("null_"), "id", "node")
    classed = materialise(classed.withColumn("place", place), "classed")
    best = classed.groupBy("root").agg(F.min("place").alias("best"))
    gone = classed.join(best, "root").where("NOT (place <=> best)").select(row_key(F.col("id"), F.col("node")).alias("key"))
    whole = docs.select(F.struct("*").alias("row"))  # names of columns can't meet those of the join
    rest = whole.withColumn("key", row_key(F.col("row")[id_col], _node(F.col("row")[text_col]))).join(gone, "key", "left_anti")
    return rest.dropDuplicates(["key"]).select("row.*")
