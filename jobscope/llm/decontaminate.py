"""Benchmark decontamination: CGK random walks map edit distance to Hamming distance, repeated bit sampling finds windows
of documents that may hold an item, and edit distance confirms.

Texts are sequences of words (letters and digits, lower case).  A walk goes over the words from a start: at step j it
writes the word it stands on and moves on if a random bit of (j, word) says so; two walks that differ by an edit fall
into step again.  A table samples K of the written words; equal samples make a candidate.  Walks start at every word of a
document and at every STRIDE-th word of an item, so an edit spoils only the starts before it.

Items of fewer than SHORT words give walks too few starts.  They are cut into one part more than the edits allowed: no
edit touches two parts, so one part at least stands unchanged in the document, and its hash finds the item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import words as W
from .tables import read

# Words by which an item and the best stretch of a document may differ, as a share of the item's words.
MAX_EDIT_SHARE = 0.2
# WALKS x SAMPLES tables; see recall() for what they reach.
WALKS, SAMPLES, STEPS, K = 2, 5, 16, 4
STRIDE = 4
# Items below this length, and those in which no walk ends, are found by the hashes of their parts, whatever the edits.
SHORT = 30
# Items are broadcast in blocks of about so many bytes of text.
BLOCK_BYTES = 8_000_000

_BITMAP = 20
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _plan() -> tuple[np.ndarray, list[list[list[int]]]]:
    """Random numbers per walk and step, and the steps that each table samples, one from each of K parts of the walk."""
    rng = np.random.default_rng(2016)
    part = STEPS // K
    steps = [[[part * q + int(rng.integers(part)) for q in range(K)] for _ in range(SAMPLES)] for _ in range(WALKS)]
    return rng.integers(1, 1 << 63, (WALKS, STEPS), dtype=np.uint64), steps


_BITS, _STEPS = _plan()


def recall(edit_share: float, n_words: int, trials: int = 2000, seed: int = 1) -> float:
    """Share of items with this many words, edited at this rate, that at least one table finds (simulated)."""
    rng = np.random.default_rng(seed)
    hits = 0
    for _ in range(trials):
        item = rng.integers(1, 1 << 62, n_words, dtype=np.uint64)
        text = []
        for w in item:
            kind = rng.random() / edit_share if edit_share else 9
            if kind >= 1:
                text.append(w)
            elif kind >= 1 / 3:  # replaced, or one more word; else left out
                text += [rng.integers(1, 1 << 62, dtype=np.uint64)] + [w] * (kind >= 2 / 3)
        if n_words < SHORT:
            hits += any(np.isin(W.windows(item[a:b], b - a), W.windows(np.array(text, dtype=np.uint64), b - a)).any() for a, b in parts(n_words))
            continue
        there = {(t, int(k)) for t, keys in enumerate(table_keys(np.array(text, dtype=np.uint64))[0]) for k in keys}
        keys, last = table_keys(item)
        starts = range(0, n_words, STRIDE)
        hits += any((t, int(keys[t][s])) in there for t in range(len(keys)) for s in starts if last[t][s] < n_words)
    return hits / trials


def parts(n: int) -> list[tuple[int, int]]:
    """The parts of an item of ``n`` words, one more than the edits it allows, as even as can be."""
    count = int(MAX_EDIT_SHARE * n) + 1
    ends = [n * i // count for i in range(count + 1)]
    return list(zip(ends, ends[1:]))


def table_keys(x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per table: the sample's hash for a walk from every word, and the last word that the sample looked at."""
    padded = np.concatenate([x, np.zeros(STEPS, np.uint64)])
    keys, last = [], []
    for walk in range(WALKS):
        place = np.arange(len(x))
        found = [np.zeros(len(x), np.uint64) for _ in range(SAMPLES)]
        ends = [place] * SAMPLES
        for j in range(STEPS):
            here = padded[place]
            for s in range(SAMPLES):
                if j in _STEPS[walk][s]:
                    found[s] = found[s] * _FOLD + here
                    ends[s] = place
            place = place + ((here * _BITS[walk, j]) >> np.uint64(63)).astype(np.int64)
        keys += found
        last += ends
    return keys, last


class Index:
    """Items of one block: their words, and per table the sorted sample hashes with the item and start they belong to."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.words = ids, []
        column = pa.array(texts, pa.string())
        for piece in W.pieces(column):
            found = W.words(W.fold(piece), W.LETTERS_DIGITS)
            self.words += [found.hash[found.first[i] : found.first[i + 1]] for i in range(piece.n)]
        self.lists = [x.tolist() for x in self.words]
        keys: list[list] = [[] for _ in range(WALKS * SAMPLES)]
        self.parts: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, x in enumerate(self.words):
            n = len(x)
            if not n:
                continue
            if n < SHORT:
                self._by_parts(i, x)
                continue
            found, last = table_keys(x)
            any_in = False
            for t in range(len(found)):
                for start in range(0, n, STRIDE):
                    if last[t][start] < n:
                        keys[t].append((int(found[t][start]), i, start))
                        any_in = True
            if not any_in:
                self._by_parts(i, x)
        self.keys, self.item, self.start, self.bitmap = [], [], [], []
        for table in keys:
            table.sort()
            key = np.array([k for k, _, _ in table], dtype=np.uint64)
            bitmap = np.zeros(1 << _BITMAP, dtype=bool)
            bitmap[key >> np.uint64(64 - _BITMAP)] = True
            self.keys.append(key)
            self.bitmap.append(bitmap)
            self.item.append(np.array([i for _, i, _ in table], dtype=np.int64))
            self.start.append(np.array([s for _, _, s in table], dtype=np.int64))

    def _by_parts(self, i: int, x: np.ndarray) -> None:
        for a, b in parts(len(x)):
            self.parts.setdefault(b - a, {}).setdefault(int(W.windows(x[a:b], b - a)[0]), []).append((i, a))

    def candidates(self, x: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of an item and the word of ``x`` where it would begin."""
        out: set[tuple[int, int]] = set()
        if not len(x):
            return out
        for t, key in enumerate(table_keys(x)[0]):
            at = np.flatnonzero(self.bitmap[t][key >> np.uint64(64 - _BITMAP)])
            low, high = np.searchsorted(self.keys[t], key[at], "left"), np.searchsorted(self.keys[t], key[at], "right")
            for a, lo, hi in zip(at[high > low], low[high > low], high[high > low]):
                out.update((int(i), int(a) - int(s)) for i, s in zip(self.item[t][lo:hi], self.start[t][lo:hi]))
        for n, items in self.parts.items():
            windows = W.windows(x, n)
            for a in np.flatnonzero(np.isin(windows, np.fromiter(items, np.uint64, len(items)))):
                out.update((i, int(a) - offset) for i, offset in items[int(windows[a])])
        return out

    def matches(self, piece: W.Piece) -> Iterator[tuple[int, int, int, int, int]]:
        """Row, item, first word, number of words, edits: the best stretch for each row and item."""
        found = W.words(W.fold(piece), W.LETTERS_DIGITS)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item, begin in sorted(self.candidates(found.hash)):
            x = self.words[item]
            slack = int(MAX_EDIT_SHARE * len(x))
            # The candidate's row is the one around the middle of the item; its stretch stays inside.
            middle = min(max(begin + len(x) // 2, 0), len(found.hash) - 1)
            for row in {int(np.searchsorted(found.first, m, side="right")) - 1 for m in (middle, min(max(begin, 0), len(found.hash) - 1))}:
                low, high = int(found.first[row]), int(found.first[row + 1])
                a, b = max(low, begin - slack), min(high, begin + len(x) + slack)
                if b <= a or (row, item) in best and best[row, item][0] == 0:
                    continue
                # An edit at least for each word of the item that the stretch does not have.
                there = set(found.hash[a:b].tolist())
                if sum(w not in there for w in self.lists[item]) > slack:
                    continue
                edits, start, end = closest(x, found.hash[a:b])
                if edits <= slack and (row, item) not in best or (row, item) in best and edits < best[row, item][0]:
                    best[row, item] = (edits, a + start - low, end - start)
        for (row, item), (edits, start, n) in sorted(best.items()):
            yield row, item, start, n, edits


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance between ``item`` and any stretch of ``text``, with one such stretch."""
    n = len(text)
    across = np.arange(n + 1)
    cost, begin = np.zeros(n + 1, dtype=np.int64), across.copy()
    for i, word in enumerate(item, 1):
        diagonal = np.append(i, cost[:-1] + (text != word))
        down = cost + 1
        step = np.minimum(diagonal, down)
        start = np.where(diagonal <= down, np.append(0, begin[:-1]), begin)
        # Moves along the row: the least of step[k] + (j - k) over k <= j, and the place it came from.
        least = np.minimum.accumulate(step - across)
        source = np.maximum.accumulate(np.where(step - across == least, across, 0))
        cost, begin = least + across, start[source]
    j = int(np.argmin(cost))
    return int(cost[j]), int(begin[j]), j


def _indexes(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    size = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64(text_col), F.lit(blocks)) == block).select(id_col, text_col).orderBy(id_col, text_col).collect()
        yield Index([r[0] for r in rows], [r[1] for r in rows])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col``, ``item_id``, ``start_word``, ``n_words`` and ``edits`` for each document and item found in it.

    An item is found in a document if some stretch of its words differs from the item's by at most MAX_EDIT_SHARE of the
    item's words (insertions, deletions, replacements).  Null and empty documents or items, and texts without words,
    match nothing.  Repeated rows are each reported.  Items are worked through in blocks of bounded size; whole
    documents are read once per block, nothing is shuffled.
    """
    slim = docs.select(F.col(id_col), F.col(text_col))
    doc_kind, item_kind = dict(slim.dtypes)[id_col], items.schema[item_id].dataType
    found = None
    for index in _indexes(items, item_id, item_text):
        part = _matched(slim, index, f"`{id_col}` {doc_kind}, `{item_id}` {item_kind.simpleString()}, start_word bigint, n_words bigint, edits int", to_arrow_type(item_kind))
        found = part if found is None else found.union(part)
    return found


def _matched(slim: DataFrame, index: Index, schema: str, item_type: pa.DataType) -> DataFrame:
    names = [part.split("`")[1] for part in schema.split(", ")[:2]] + ["start_word", "n_words", "edits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items, starts, sizes, edits = [], [], [], [], []
            for piece in W.pieces(batch.column(1)):
                for row, item, start, n, cost in index.matches(piece):
                    rows.append(piece.first + row)
                    items.append(index.ids[item])
                    starts.append(start)
                    sizes.append(n)
                    edits.append(cost)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, item_type), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(edits, pa.int32())],
                names=names,
            )

    return slim.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item is found; the others are unchanged.  No shuffle."""
    place = docs.columns.index(text_col)
    for index in _indexes(items, item_id, item_text):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for piece in W.pieces(batch.column(place)):
                    for row, *_ in index.matches(piece):
                        keep[piece.first + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
