"""Whitening of embeddings: QR by blocks reduces the centred rows, Householder reflections bidiagonalise what is left,
dqds finds its singular values, twisted factorisations their vectors, and these give the whitening directions.

Tasks work on blocks of rows.  What goes through the driver is one vector of sums and one triangle, whose size is that
of the embedding and not that of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .tables import read

COMPONENTS = 32
# Whole numbers are made of entries: floor(SCALE * entry) + OFFSET.  Entries of LARGE and more have no place in them.
SCALE, OFFSET, LARGE = 64, 1_000_000, 2.0**40
# Partial results that are combined in one task, about.
FAN_IN = 8
# Rows of a block that is reduced at once, in widths of a row.
BLOCK = 8

EPS = np.finfo(np.float64).eps


# --- small dense work on the driver ------------------------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A unit vector w, so that x - 2 w (w x) has only its first entry, and that entry."""
    size = np.linalg.norm(x)
    if size == 0 or len(x) == 1:
        return np.zeros_like(x), float(x[0])
    first = -size if x[0] > 0 else size
    w = x.copy()
    w[0] -= first
    return w / np.linalg.norm(w), float(first)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor v of r = u b v', by Householder reflections from both sides."""
    a, n = np.array(r, dtype=np.float64), len(r)
    v, diagonal, upper = np.eye(n), np.zeros(n), np.zeros(max(n - 1, 0))
    for k in range(n):
        w, diagonal[k] = _reflector(a[k:, k])
        a[k:, k + 1 :] -= 2 * np.outer(w, w @ a[k:, k + 1 :])
        if k + 1 < n:
            w, upper[k] = _reflector(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ w, w)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return diagonal, upper, v


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling, each to high relative accuracy.

    Quotient-difference steps with shifts: the inverses of the auxiliary quantities of a step add up to the trace of the
    inverse, so one over their sum is below the smallest value and a safe next shift.
    """
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper]
    total, shift, found, small = 0.0, 0.0, [], (EPS / 4) ** 2
    while len(q) > 1:
        if e[-1] <= small * (total + q[-1]):
            found.append(total + q.pop())
            e.pop()
            continue
        while True:
            d, inverse, q_next, e_next = q[0] - shift, 0.0, [], []
            for i in range(len(e)):
                if d < 0:
                    break
                inverse += 1 / d if d > 0 else np.inf
                q_next.append(d + e[i])
                share = q[i + 1] / q_next[i] if q_next[i] > 0 else 0.0
                e_next.append(e[i] * share)
                d = d * share - shift
            if d >= 0 and len(q_next) == len(e):
                break
            shift = shift / 4 if shift > EPS * EPS * total else 0.0
        inverse += 1 / d if d > 0 else np.inf
        q, e, total = [*q_next, d], e_next, total + shift
        shift = 1 / inverse * (1 - 4 * EPS * len(q))
    return np.sort(np.array([*found, *[total + x for x in q]]))[::-1]


def twisted(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors (columns) of b'b for the values, each from the twisted factorisation with the least pivot.

    A matrix that falls into blocks, where an upper entry is nothing next to the diagonal, gives each block its values.
    """
    n, out = len(diagonal), np.zeros((len(diagonal), len(values)))
    top = max(np.abs(diagonal).max(), np.abs(upper).max(initial=0))
    cuts = [0, *(np.flatnonzero(np.abs(upper) <= EPS * top) + 1), n]
    own = [dqds(diagonal[a:b], upper[a : b - 1]) for a, b in zip(cuts, cuts[1:])]
    block = np.concatenate([np.full(len(x), i) for i, x in enumerate(own)])
    order = np.argsort(-np.concatenate(own), kind="stable")
    for column, (which, value) in enumerate(zip(block[order], values)):
        a, b = cuts[which], cuts[which + 1]
        out[a:b, column] = _vector(diagonal[a:b], upper[a : b - 1], float(value))
    return out


def _vector(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    n, tiny = len(diagonal), np.finfo(np.float64).tiny
    pivot = lambda x: x if abs(x) > tiny else tiny
    d, l = diagonal**2, upper / diagonal[:-1]
    s, p, down, up = np.zeros(n), np.zeros(n), np.zeros(n - 1), np.zeros(n - 1)
    for i in range(n - 1):  # from the top
        rest = s[i] - value
        down[i] = l[i] * d[i] / pivot(d[i] + rest)
        s[i + 1] = rest * down[i] * l[i]
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):  # from the bottom
        share = d[i] / pivot(l[i] ** 2 * d[i] + p[i + 1])
        up[i] = l[i] * share
        p[i] = p[i + 1] * share - value
    gap = np.abs(s + p)
    twist = int(np.argmin(np.where(np.isfinite(gap), gap, np.inf)))
    z = np.zeros(n)
    z[twist] = 1
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    z = np.nan_to_num(z, posinf=0, neginf=0)
    return z / np.linalg.norm(z)


def _parted(b: np.ndarray, z: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """The vectors made orthogonal, and turned within pairs until b z is too.

    Where values lie apart nothing is left to turn; vectors of values that agree to many digits are parted here.
    """
    z = np.linalg.qr(z)[0]
    for _ in range(sweeps):
        w = b @ z
        gram, size = w.T @ w, np.linalg.norm(w, axis=0)
        off = np.abs(np.triu(gram, 1)) > 8 * EPS * np.outer(size, size)
        if not off.any():
            break
        for i, j in np.argwhere(off):
            x, y = b @ z[:, i], b @ z[:, j]
            cross = x @ y
            if abs(cross) <= 2 * EPS * np.linalg.norm(x) * np.linalg.norm(y):
                continue
            angle = (y @ y - x @ x) / (2 * cross)
            t = (1 if angle >= 0 else -1) / (abs(angle) + np.hypot(1, angle))
            c = 1 / np.hypot(1, t)
            z[:, i], z[:, j] = c * (z[:, i] - t * z[:, j]), c * (z[:, j] + t * z[:, i])
    order = np.argsort(-np.linalg.norm(b @ z, axis=0), kind="stable")
    return z[:, order]


def principal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of r'r, falling, and unit eigenvectors as columns; those of rank zero in r are left out."""
    n, top = len(r), np.abs(r).max(initial=0)
    if not top:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, upper, v = bidiagonalise(r / top)
    # No diagonal entry may be zero; what is added is less than the rounding of the largest.
    small = EPS * EPS * np.abs(diagonal).max()
    diagonal = np.where(np.abs(diagonal) < small, small, diagonal)
    values = dqds(diagonal, upper)
    z = _parted(np.diag(diagonal) + np.diag(upper, 1), twisted(diagonal, upper, values))
    kept = values > (n * EPS) ** 2 * values[0]
    return values[kept] * top**2, (v @ z)[:, kept]


# --- blocks of rows in tasks --------------------------------------------------------------------


def _rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The whole-number rows of a list column by width: width, places, matrix.  Rows that hold no number are left out."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    flat = column.flatten()
    values = np.asarray(pc.fill_null(flat, np.nan).cast(pa.float64()))
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(values) < LARGE)
    length = np.maximum(sizes, 0)
    row = np.repeat(np.arange(len(sizes)), length)
    good = (np.bincount(row, bad, len(sizes)) == 0) & (sizes >= 0)
    for width in np.unique(sizes[good]):
        chosen = good & (sizes == width)
        whole = np.floor(SCALE * values[np.repeat(chosen, length)]).astype(np.int64) + OFFSET
        yield int(width), np.flatnonzero(chosen), whole.reshape(chosen.sum(), width)


def _of_width(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    for found, place, x in _rows(column):
        if found == width:
            return place, x
    return np.zeros(0, np.int64), np.zeros((0, width), np.int64)


def _sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and sums per dimension of the width that most rows have (at a tie the larger)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in _rows(batch.column(0)):
                held[width] = held.get(width, 0) + np.append(x.sum(axis=0), len(x))
        for width, sums in held.items():
            place = pa.array(np.arange(width + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width + 1, width), pa.int32()), place, pa.array(sums, pa.int64())], names=["width", "place", "total"])

    parts = vectors.select("vector").mapInArrow(run, "width int, place int, total bigint")
    totals = materialise(parts.groupBy("width", "place").agg(F.sum("total").alias("total")), "whitening-sums")
    most = totals.where("place = width").orderBy(F.desc("total"), F.desc("width")).select("width", "total").first()
    if most is None:
        return 0, np.zeros(0, np.int64)
    rows = totals.where((F.col("width") == most["width"]) & (F.col("place") < F.col("width"))).orderBy("place").select("total").collect()
    return most["total"], np.array([r["total"] for r in rows], np.int64)


def _folded(parts: DataFrame, combine: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """All partial results (``slot``, ``part``: doubles in binary) combined in rounds, none of which gathers many."""

    def run(group: pa.Table) -> pa.Table:
        whole = combine([np.frombuffer(x, np.float64) for x in group.column("part").to_pylist()])
        return pa.table({"slot": pa.array([group.column("slot")[0].as_py()], pa.int64()), "part": pa.array([whole.tobytes()], pa.binary())})

    while True:
        parts = materialise(parts, "whitening-parts")
        left = parts.count()
        if left <= 1:
            row = parts.first()
            return None if row is None else np.frombuffer(row["part"], np.float64)
        group = F.pmod(F.xxhash64("slot", F.lit(left)), F.lit(-(-left // FAN_IN)))
        parts = parts.select(group.alias("slot"), "part").groupBy("slot").applyInArrow(run, "slot bigint, part binary")


def _partials(vectors: DataFrame, width: int, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """One partial result per task: ``add`` takes it and the whole-number rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, some = start(), False
        for batch in batches:
            x = _of_width(batch.column(0), width)[1]
            if len(x):
                state, some = add(state, x), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(state, np.float64).tobytes()], pa.binary())], names=["part"])

    return vectors.select("vector").mapInArrow(run, "part binary").select(F.spark_partition_id().cast("bigint").alias("slot"), "part")


@dataclass(frozen=True)
class Whitening:
    """Rows and sums it was fitted on, eigenvalues of the covariance, directions as columns, and its trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    directions: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.directions / np.sqrt(self.values))


def _triangle(rows: np.ndarray, width: int) -> np.ndarray:
    """The triangle of QR, filled up with zeros to ``width`` rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fits on the column ``vector`` (doubles) of all rows; see :func:`whiten` for what counts."""
    n, sums = _sums(vectors)
    width = len(sums)
    if not n or not width:
        return Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    centre = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0).centred

    def add(r: np.ndarray, x: np.ndarray) -> np.ndarray:
        for i in range(0, len(x), BLOCK * width):
            r = _triangle(np.vstack([r, centre(x[i : i + BLOCK * width])]), width)
        return r

    def combine(parts: list[np.ndarray]) -> np.ndarray:
        return _triangle(np.vstack([x.reshape(width, width) for x in parts]), width)

    r = _folded(_partials(vectors, width, lambda: np.zeros((0, width)), add), combine).reshape(width, width)
    values, directions = principal(r)
    return Whitening(n, sums, values[:components] / n, directions[:, :components], float(values.sum()) / n)


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, from all rows."""
    k = len(fitted.values)

    def add(state: np.ndarray, x: np.ndarray) -> np.ndarray:
        w = np.hstack([fitted.apply(x), np.ones((len(x), 1))])
        return state + w.T @ w

    parts = _partials(vectors, len(fitted.sums), lambda: np.zeros((k + 1, k + 1)), add)
    moments = _folded(parts, lambda found: np.sum(found, axis=0)).reshape(k + 1, k + 1) / fitted.n
    mean = moments[:k, k]
    return float(np.abs(moments[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum of (n x - S) squared of each row, exact; null where a long can't hold it."""
    d = n * x - sums
    if not d.size or float(np.abs(d).max()) ** 2 * d.shape[1] < 2**62:
        return pa.array((d * d).sum(axis=1), pa.int64())
    exact = [sum(int(y) ** 2 for y in row) for row in d]
    return pa.array([y if y < 2**63 else None for y in exact], pa.int64())


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: ``id_col``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``,
    ``explained`` and ``identity_error``.

    A vector counts, in the fit and in the result, unless it is null, holds a null or an entry that is not finite or of
    2**40 and more, or has another width than most vectors have (at a tie the larger width wins).  Entries become whole
    numbers ``floor(64 c) + 1000000``, so sums and deviations are exact; a deviation beyond a long is null.  Components
    fall by variance; those without any (constant dimensions, fewer rows than dimensions) are left out, so one row, equal
    rows or an empty table give an empty result.  Repeated rows and null ids count like others; other columns are not read.
    """
    id_type = table.schema[id_col].dataType.simpleString()
    vectors = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    fitted = fit(vectors, components)
    k, width = len(fitted.values), len(fitted.sums)
    schema = f"id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not k:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    error, explained = identity_error(vectors, fitted), fitted.values / fitted.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, x = _of_width(batch.column(1), width)
            for i in range(0, len(x), 1024):
                part, rows = x[i : i + 1024], len(x[i : i + 1024])
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(place[i : i + 1024], k))), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    pa.array(np.full(rows * k, fitted.n), pa.int64()), _deviations(part, fitted.n, fitted.sums).take(each),
                    pa.array(fitted.apply(part).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
