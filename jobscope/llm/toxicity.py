"""Toxicity by a classifier chain: categories are predicted one after another, each linear model also gets the
probabilities of the categories before it, learned with out-of-fold predictions.

Terms that tell toxic from other training documents are counted over all labelled training rows; the chain is fitted on
a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .tables import in_training, read

# Bounds: terms that are features, labelled rows that the chain is fitted on, cells that terms are hashed to.
TERMS = 192
MAX_LABELLED = 16_000
CELLS = 1 << 20
FOLDS = 5
# The chain.  The tables label one category; the two before it are drawn from it: documents labelled toxic in which a
# listed term stands at all, and those where such terms are at least one word in DENSE.
CATEGORIES = ("mention", "dense", "toxic")
DENSE = 50


def _cells(piece: W.Piece) -> tuple[W.Words, np.ndarray]:
    found = W.words(W.fold(piece), W.LETTERS)
    return found, (found.hash >> np.uint64(20)).astype(np.int64) % CELLS


def term_table(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``cell``, and in how many toxic and other documents a word of that cell occurs, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, CELLS), dtype=np.int32)
        for batch in batches:
            toxic = np.asarray(batch.column(1).fill_null(0)).astype(np.int64) != 0
            for piece in W.pieces(batch.column(0)):
                found, cell = _cells(piece)
                pair = np.unique(found.row() * CELLS + cell)
                row, cell = pair // CELLS, pair % CELLS
                hit = toxic[piece.first + row]
                seen[1] += np.bincount(cell[hit], minlength=CELLS).astype(np.int32)
                seen[0] += np.bincount(cell[~hit], minlength=CELLS).astype(np.int32)
        some = np.flatnonzero(seen[0] + seen[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array(seen[1][some], pa.int32()), pa.array(seen[0][some], pa.int32())], names=["cell", "toxic", "other"]
        )

    return (
        labelled.select(text_col, label_col).mapInArrow(run, "cell bigint, toxic int, other int")
        .groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    )


def top_terms(labelled: DataFrame, text_col: str, label_col: str) -> np.ndarray:
    """The cells with the strongest lean to toxic documents, TERMS at most, strongest first."""
    sizes = labelled.agg(F.sum(F.coalesce(F.col(label_col) != 0, F.lit(False)).cast("int")).alias("t"), F.count("*").alias("n")).first()
    toxic, other = max(sizes["t"] or 0, 1), max(sizes["n"] - (sizes["t"] or 0), 1)
    t, o = F.col("toxic") / toxic, F.col("other") / other
    expected = (F.col("toxic") + F.col("other")) * (toxic / (toxic + other))
    lean = (F.col("toxic") - expected) / F.sqrt(expected * (other / (toxic + other)) + 1)
    rows = (
        term_table(labelled, text_col, label_col)
        .where((F.col("toxic") >= max(3, toxic // 1500)) & (t > 3 * o))
        .orderBy(lean.desc(), "cell").limit(TERMS).collect()
    )
    return np.array([r["cell"] for r in rows], dtype=np.int64)


def features(column: pa.Array, terms: np.ndarray) -> np.ndarray:
    """Per text: whether and how often each term occurs, all terms together, and their density; empty texts have zeros."""
    place = np.full(CELLS, -1, dtype=np.int32)
    place[terms] = np.arange(len(terms))
    out = np.zeros((len(column), len(terms) + 4), dtype=np.float32)
    for piece in W.pieces(column):
        found, cell = _cells(piece)
        term = place[cell]
        hit = np.flatnonzero(term >= 0)
        row = np.searchsorted(found.first, hit, side="right") - 1
        count = np.bincount(row * len(terms) + term[hit], minlength=piece.n * len(terms)).reshape(piece.n, len(terms)) if len(terms) else np.zeros((piece.n, 0))
        total, size = count.sum(axis=1), np.maximum(np.diff(found.first), 1)
        rows = slice(piece.first, piece.first + piece.n)
        out[rows, : len(terms)] = np.minimum(count, 1)
        out[rows, len(terms) :] = np.stack([total > 0, np.log1p(total), np.minimum(DENSE * total / size, 3), (count > 0).sum(axis=1) > 1], axis=1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last number is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], weight)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """``terms`` and one weight vector per category; a later one has a number more for each category before it."""

    def __init__(self, terms: np.ndarray, weights: list[np.ndarray]):
        self.terms, self.weights = terms, weights

    def predict(self, column: pa.Array) -> np.ndarray:
        x = features(column, self.terms)
        for k, w in enumerate(self.weights):
            p = _probability(x, w)
            x = np.hstack([x, p[:, None]])
        return x[:, -len(self.weights) :]


def fit_chain(x: np.ndarray, toxic: np.ndarray, terms: np.ndarray, fold: np.ndarray) -> Chain:
    """Models in chain order; the probabilities a later one learns from come from models that did not see the row."""
    any_term, dense = x[:, len(terms)] > 0, x[:, len(terms) + 2] >= 1
    targets = [toxic & any_term, toxic & dense, toxic]
    weights = []
    for y in targets:
        weights.append(_logistic(x, y))
        unseen = np.zeros(len(x))
        for f in range(FOLDS):
            out = fold == f
            if out.any() and not out.all():
                unseen[out] = _probability(x[out], _logistic(x[~out], y[~out]))
            elif out.any():
                unseen[out] = y.mean()
        x = np.hstack([x, unseen[:, None]])
    return Chain(terms, weights)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain | None:
    """The chain learned from ``labels`` (``id_col``, ``label_col``); None without toxic and other rows.

    Rows with a null id or label are left out; of an id labelled twice the larger label counts.
    """
    truth = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label_"))
    # A join of one kind at every size: labels are a share of the documents, so they are never broadcast.
    labelled = docs.select(id_col, text_col).join(truth.hint("merge"), id_col)
    terms = top_terms(labelled, text_col, "label_")
    drawn = truth.orderBy(F.xxhash64(id_col), id_col).limit(MAX_LABELLED)
    sample = docs.select(id_col, text_col).join(F.broadcast(drawn), id_col).select(
        text_col, F.col("label_").cast("int").alias("label_"), F.pmod(F.xxhash64(id_col, F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"),
        F.col(id_col).cast("string").alias("key"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0), terms).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), *[batch.column(i) for i in (1, 2, 3)]], names=["x", "label", "fold", "key"])

    rows = sorted(sample.mapInArrow(run, "x binary, label int, fold int, key string").collect(), key=lambda r: (r["key"], bytes(r["x"])))
    toxic = np.array([r["label"] != 0 for r in rows], dtype=bool)
    if not toxic.any() or toxic.all():
        return None
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    return fit_chain(x, toxic, terms, np.array([r["fold"] for r in rows]))


def classify(docs: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """``docs`` with the probability ``p_<category>`` of each category and ``is_toxic`` (the last one is 0.5 or more).

    Columns of these names are replaced.  Null and empty texts have no terms.  Without a chain all probabilities are 0.
    """
    made = [f"p_{c}" for c in CATEGORIES]
    docs = docs.drop(*made, "is_toxic")
    names = list(docs.columns)
    place = names.index(text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{c} double" for c in made] + ["is_toxic boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros((batch.num_rows, len(made))) if chain is None else chain.predict(batch.column(place))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns += [pa.array(p[:, k].astype(np.float64), pa.float64()) for k in range(len(made))] + [pa.array(p[:, -1] >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *made, "is_toxic"])

    return docs.mapInArrow(run, schema)


def trained_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Chain | None:
    labels = read(spark, sf_dir, "labels")
    return fit(docs, labels.where(in_training(F.col("doc_id"))).select("doc_id", "toxic"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, trained_chain(spark, docs, sf_dir)).drop("text")


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that the chain calls toxic."""
    chain, place = trained_chain(spark, docs, sf_dir), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch if chain is None else batch.filter(pa.array(chain.predict(batch.column(place))[:, -1] < 0.5))

    return docs.mapInArrow(run, docs.schema)  # the columns of docs as they are, also those that classify would replace
