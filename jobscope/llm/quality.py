"""Quality classifier by positive-unlabelled learning: trusted positives, unlabelled web text, an estimated class prior,
and the non-negative unbiased risk.

Features are shares of bytes and byte pairs and measures of repetition, over the whole text.  Three passes: a bounded
sample for fitting, one histogram of a first model's scores over all documents for the class prior, and the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .tables import in_training, read

# Bounds of the sample that the model is fitted on: trusted positives, unlabelled documents.
MAX_POSITIVES = 4_000
MAX_UNLABELLED = 12_000

PAIRS = 256
EXTRA = 10
WIDTH = 256 + PAIRS + EXTRA
BINS = 400


def features(column: pa.Array) -> np.ndarray:
    """One row of WIDTH numbers per text; null and empty texts have zeros but for the last, which marks them."""
    out = np.zeros((len(column), WIDTH), dtype=np.float32)
    for piece in W.pieces(column):
        sizes = np.diff(piece.offsets)
        n, rows = piece.n, slice(piece.first, piece.first + piece.n)
        row_of = np.repeat(np.arange(n, dtype=np.int32), sizes)
        total = np.maximum(sizes, 1)[:, None]
        single = np.bincount(row_of * 256 + piece.data, minlength=n * 256).reshape(n, 256)
        out[rows, :256] = np.sqrt(single / total)
        if len(piece.data) > 1:
            # Digits and letters count as one kind each, so pairs tell about marks, case and blanks.
            kind = _KINDS[piece.data]
            pair = kind[:-1] * np.int32(16) + kind[1:]
            same = row_of[:-1] == row_of[1:]
            double = np.bincount(row_of[:-1][same] * PAIRS + pair[same], minlength=n * PAIRS).reshape(n, PAIRS)
            out[rows, 256 : 256 + PAIRS] = np.sqrt(double / total)
        found = W.words(piece, W.NOT_BLANK)
        counts = np.diff(found.first)
        row, h = found.row(), found.hash
        some = np.maximum(counts, 1)
        extra = np.zeros((n, EXTRA), dtype=np.float32)
        extra[:, 0], extra[:, 1] = np.log1p(sizes) / 10, np.log1p(counts) / 10
        extra[:, 2] = np.minimum((sizes / some) / 20, 3)
        for j, gap in ((3, 1), (4, 2)):
            if len(h) > gap:
                again = (h[gap:] == h[:-gap]) & (row[gap:] == row[:-gap])
                extra[:, j] = np.bincount(row[gap:][again], minlength=n) / some
        key = W.mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        extra[:, 5] = np.bincount(_first_of(key, row), minlength=n) / some
        runs = W.windows(h, 5)
        inside = W.window_rows(found, 5)
        if inside.any():
            start = row[: len(runs)][inside]
            key = W.mix(runs[inside] + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            extra[:, 6] = 1 - np.bincount(_first_of(key, start), minlength=n) / np.maximum(np.bincount(start, minlength=n), 1)
        lines = np.bincount(row_of[piece.data == 10], minlength=n) + 1
        extra[:, 7] = np.log1p(lines) / 5
        extra[:, 8] = np.minimum(lines / some, 2)
        extra[:, 9] = counts == 0
        out[rows, 256 + PAIRS :] = extra
    return out


def _first_of(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The rows of the distinct keys; a key holds its row."""
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = sorted_key[1:] != sorted_key[:-1]
    return row[order[fresh]]


def _byte_kinds() -> np.ndarray:
    """Sixteen kinds of bytes: blank, line feed, digit, small, capital, outside ASCII, and marks by their code."""
    kinds = np.zeros(256, dtype=np.int32)
    for b in range(256):
        if b in (32, 9):
            kinds[b] = 0
        elif b in (10, 13):
            kinds[b] = 1
        elif 48 <= b < 58:
            kinds[b] = 2
        elif 97 <= b < 123:
            kinds[b] = 3
        elif 65 <= b < 91:
            kinds[b] = 4
        elif b >= 128:
            kinds[b] = 5
        else:
            kinds[b] = 6 + b % 10
    return kinds


_KINDS = _byte_kinds()


class Linear:
    """A linear score on scaled features, as a probability."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float):
        self.mean, self.scale, self.weight, self.bias = mean, scale, weight, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 5, steps: int = 1500, batch: int = 512) -> Linear:
    """Least non-negative risk with logistic loss; ``prior`` None fits positives against unlabelled instead.

    The risk of calling an unlabelled row negative, less what positives among them add, estimates the risk on negatives
    and cannot be below 0; where a batch has it below, the step goes against that part alone, which undoes overfitting.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    weight, bias = np.zeros(p.shape[1]), 0.0
    first, second = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        zp, zu = xp @ weight + bias, xu @ weight + bias
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        if prior is None:
            gp, gu = (sp - 1) / batch, su / batch
        else:
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                gp, gu = prior * (sp - 1) / batch - prior * sp / batch, su / batch
            else:
                gp, gu = prior * sp / batch, -su / batch
        gradient = np.append(gp @ xp + gu @ xu + 2e-4 * weight, gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return Linear(mean.astype(np.float32), scale.astype(np.float32), weight.astype(np.float32), float(bias))


def estimate_prior(positive: np.ndarray, everything: np.ndarray) -> float:
    """Share of positives among all rows from two histograms of a score that is higher for positives.

    Above any threshold lie at least the positives' part of all rows; the least ratio of the tails, where the positives'
    tail still has a fair share, is the largest prior that no threshold contradicts.
    """
    p = np.cumsum(positive[::-1])[::-1] / max(positive.sum(), 1)
    u = np.cumsum(everything[::-1])[::-1] / max(everything.sum(), 1)
    fair = p >= 0.5
    slack = np.sqrt(1 / max(positive.sum(), 1))
    return float(np.clip((u[fair] / np.maximum(p[fair] - slack * np.sqrt(1 - p[fair]), 1e-9)).min(), 0.01, 0.99))


def _half(id_col: str) -> "F.Column":
    return F.pmod(F.xxhash64(id_col, F.lit("half")), F.lit(2)).cast("int")


def _sampled_features(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and half of the sampled rows, in an order that does not depend on how they came in."""
    picked = docs.join(F.broadcast(ids), id_col, "left_semi").select(text_col, _half(id_col).alias("half"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary()), batch.column(1)], names=["x", "half"])

    rows = picked.mapInArrow(run, "x binary, half int").collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, WIDTH)
    order = np.lexsort(x.T[:64])
    return x[order], np.array([r["half"] for r in rows], dtype=int)[order]


def fit(docs: DataFrame, positive_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Linear | None, float]:
    """The model and the class prior.  ``positive_ids`` has the ids of the trusted positives; None without any.

    MAX_POSITIVES and MAX_UNLABELLED bound the rows the driver fits on, each drawn by a hash of the id; the prior counts
    all documents.  It is taken from the scores of two first models, each on the half of the ids it was not fitted on:
    a model's own rows look more apart than they are.
    """
    slim = docs.select(id_col, text_col)
    trusted = positive_ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    sampled = trusted.orderBy(F.xxhash64(id_col), id_col).limit(MAX_POSITIVES)
    drawn = slim.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col, F.lit("u")), id_col).limit(MAX_UNLABELLED)
    p, p_half = _sampled_features(slim, sampled, id_col, text_col)
    u, u_half = _sampled_features(slim, drawn, id_col, text_col)
    if not len(p) or not len(u):
        return None, 0.5
    if min(np.bincount(p_half, minlength=2).min(), np.bincount(u_half, minlength=2).min()) == 0:
        p_half, u_half = np.arange(len(p)) % 2, np.arange(len(u)) % 2
    pick = lambda x, half, h: x[half == h] if (half == h).any() else x
    rough = [fit_nnpu(pick(p, p_half, 1 - h), pick(u, u_half, 1 - h), None) for h in (0, 1)]  # of half h: fitted on the other

    def bins(x: np.ndarray, half: np.ndarray) -> np.ndarray:
        scores = np.where(half == 0, rough[0].score(x), rough[1].score(x))
        return np.bincount(np.minimum((scores * BINS).astype(int), BINS - 1), minlength=BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            counts += bins(features(batch.column(0)), np.asarray(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(counts)], names=["bin", "n"])

    histogram = np.zeros(BINS)
    halved = slim.select(text_col, _half(id_col).alias("half"))
    for row in halved.mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        histogram[row["bin"]] = row["n"]
    prior = estimate_prior(bins(p, p_half), histogram)
    return fit_nnpu(p, u, prior), prior


def score(docs: DataFrame, model: Linear | None, prior: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row; without a model, the prior."""
    slim = docs.select(id_col, text_col)
    kind = dict(slim.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(batch.num_rows, prior) if model is None else model.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.float64), pa.float64())], names=[id_col, "score"])

    return slim.mapInArrow(run, f"`{id_col}` {kind}, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    positives = labels.where(in_training(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id")
    model, prior = fit(docs, positives)
    return score(docs, model, prior).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
