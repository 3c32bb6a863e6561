"""Substring dedup with suffix automata: documents stream through automata of reference shards for matching statistics,
and spans at or above the length threshold are removed.

The reference is the corpus itself, of which no bound is known, so automata are not broadcast: each passage travels to
the shard that holds all passages it can share a window with.  An anchor of a window is the least hash among its word
runs of ANCHOR words; equal windows have equal anchors.  Windows with one anchor lie side by side, and the words they
span are a context.  Contexts of anchors that occur once hold no repeated window and stay where they are; the others,
each distinct one once, go to the shard of their anchor, whose automaton counts how often each window occurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from . import words as W
from .tables import partitions, read

WINDOW = 35
ANCHOR = 8
# An anchor that occurs more often sends its windows one by one, each to the shard of its own words, so that no shard
# has to hold the contexts of a phrase that a third of all documents share.
HOT = 400


def anchors(hashed: np.ndarray, window: int = WINDOW, run: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one document's words: anchor hash, first and last window start that has it; leftmost of equal hashes."""
    n = len(hashed) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    runs = W.windows(hashed, run)
    span = window - run + 1
    # Least of every `span` neighbours, by doubling; ties keep the left one.
    best, width = np.arange(len(runs)), 1
    while width < span:
        step = min(width, span - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(runs[right] < runs[left], right, left)
        width += step
    change = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    return runs[best[change]], change, np.append(change[1:], n) - 1


class Automaton:
    """Suffix automaton of several word sequences; ``occurrences`` counts them with their weights."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def _new(self, size: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.count.append(0)
        return len(self.size) - 1

    def _split(self, state: int, word, target: int) -> int:
        """The state for ``state`` + ``word`` alone, where longer strings share ``target``."""
        if self.size[target] == self.size[state] + 1:
            return target
        twin = self._new(self.size[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = twin
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def add(self, sequence: list, weight: int) -> None:
        last = 0
        for word in sequence:
            target = self.next[last].get(word)
            if target is not None:
                last = self._split(last, word, target)
            else:
                fresh = self._new(self.size[last] + 1, {}, 0)
                state = last
                while state >= 0 and word not in self.next[state]:
                    self.next[state][word] = fresh
                    state = self.link[state]
                if state >= 0:
                    self.link[fresh] = self._split(state, word, self.next[state][word])
                last = fresh
            self.count[last] += weight

    def close(self) -> None:
        """Sums counts along suffix links; call once, after the last sequence."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.count[self.link[state]] += self.count[state]

    def repeated(self, sequence: list, window: int) -> list[int]:
        """Starts of the windows of ``sequence`` that occur more than once, by matching statistics."""
        state, matched, starts = 0, 0, []
        for i, word in enumerate(sequence):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            target = self.next[state].get(word)
            if target is None:
                continue
            state, matched = target, matched + 1
            while self.size[self.link[state]] >= window:
                state = self.link[state]
                matched = self.size[state]
            if matched >= window and self.count[state] > 1:
                starts.append(i - window + 1)
        return starts


def _node(text) -> "F.Column":
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """``anchor``, ``node``, ``low``, ``high`` of every text (``node``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch.column(1)):
                found = W.words(piece, W.NOT_BLANK)
                key, low, high, row = [], [], [], []
                for i in np.flatnonzero(np.diff(found.first) >= WINDOW):
                    k, a, b = anchors(found.hash[found.first[i] : found.first[i + 1]])
                    key.append(k), low.append(a), high.append(b), row.append(np.full(len(k), piece.first + i))
                if key:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(key).astype(np.int64)), batch.column(0).take(pa.array(np.concatenate(row))),
                            pa.array(np.concatenate(low).astype(np.int32)), pa.array(np.concatenate(high).astype(np.int32)),
                        ],
                        names=["anchor", "node", "low", "high"],
                    )

    return texts.select("node", "text").mapInArrow(run, "anchor bigint, node binary, low int, high int")


def _contexts(joined: DataFrame, with_text: bool) -> DataFrame:
    """Contexts of texts (``node``, ``text``, ``places``: low, high, anchor, hot): shard key, digest, and the place, or the
    words with how often the batch has them, so that a passage of many texts is counted before it is exchanged."""
    schema = "shard bigint, digest binary, " + ("words binary, n bigint" if with_text else "node binary, low int")

    def pieces(text: str | None, listed: list) -> Iterator[tuple[int, bytes, bytes, int]]:
        found = (text or "").encode().split()
        for place in listed:
            low, high = place["low"], place["high"]
            for a, b in [(a, a) for a in range(low, high + 1)] if place["hot"] else [(low, high)]:
                piece = b" ".join(found[a : b + WINDOW])
                name = hashlib.blake2b(piece, digest_size=16).digest()
                yield int.from_bytes(name[:8], "big", signed=True) if place["hot"] else place["anchor"], name, piece, a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)))
            if with_text:
                seen: dict[tuple[int, bytes], list] = {}
                for _, text, listed in rows:
                    for shard, name, piece, _ in pieces(text, listed):
                        seen.setdefault((shard, name), [piece, 0])[1] += 1
                columns = [[k for k, _ in seen], [d for _, d in seen], [v[0] for v in seen.values()], [v[1] for v in seen.values()]]
                kinds, names = (pa.int64(), pa.binary(), pa.binary(), pa.int64()), ["shard", "digest", "words", "n"]
            else:
                columns = [[], [], [], []]
                for node, text, listed in rows:
                    for shard, name, _, start in pieces(text, listed):
                        for column, value in zip(columns, (shard, name, node, start)):
                            column.append(value)
                kinds, names = (pa.int64(), pa.binary(), pa.binary(), pa.int32()), ["shard", "digest", "node", "low"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return joined.select("node", "text", "places").mapInArrow(run, schema)


def _streamed(contexts: DataFrame) -> DataFrame:
    """``shard``, ``digest``, ``starts`` of the distinct contexts that have repeated windows.

    ``contexts`` (``shard``, ``digest``, ``words``, ``n``) may list a context several times, once for each batch."""

    def answer(group: list[tuple[bytes, bytes, int]]) -> Iterator[tuple[bytes, list[int]]]:
        sequences = [(digest, words.split(b" "), n) for digest, words, n in group]
        if len(group) == 1 and group[0][2] < 2:
            return  # one context, once: no window of it can repeat
        automaton = Automaton()
        for _, sequence, n in sequences:
            automaton.add(sequence, n)
        automaton.close()
        for digest, sequence, _ in sequences:
            if starts := automaton.repeated(sequence, WINDOW):
                yield digest, starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group = None, []
        out: tuple[list, list, list] = ([], [], [])

        def flush() -> None:
            for digest, starts in answer(group):
                out[0].append(shard), out[1].append(digest), out[2].append(starts)

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int32()))], names=["shard", "digest", "starts"]
            )
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for key, digest, words, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != shard:
                    flush()
                    shard, group = key, []
                if group and group[-1][0] == digest:
                    group[-1] = (digest, words, group[-1][2] + n)
                else:
                    group.append((digest, words, n))
            yield made()
        flush()
        yield made()

    return (
        contexts.select("shard", "digest", "words", "n").sortWithinPartitions("shard", "digest")
        .mapInArrow(run, "shard bigint, digest binary, starts array<int>")
    )


def _cut(joined: DataFrame) -> DataFrame:
    """``node``, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept`` of texts (``node``, ``text``, ``starts``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, kept = [], [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = (text or "").encode().split()
                n = len(found)
                if starts:
                    depth = np.zeros(n + 1, dtype=np.int64)
                    at = np.unique(np.array(starts))
                    depth[at] += 1
                    depth[at + WINDOW] -= 1
                    keep = np.cumsum(depth[:n]) == 0
                    found = [word for word, k in zip(found, keep) if k]
                rest = b" ".join(found)
                counts.append(n)
                removed.append(n - len(found))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
                names=["node", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return joined.select("node", "text", "starts").mapInArrow(run, "node binary, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed``, ``kept_sha256`` (and ``kept``, the text that is left) of every row.

    Words are runs of other bytes than blank, tab, line feed, vertical tab, form feed and carriage return.  A word goes
    if a window of WINDOW words around it also starts anywhere else, in the same row too.  Null counts as the empty text;
    shorter texts keep all words.  Ids play no part: rows that repeat an id, or have none, are judged by their texts, and
    copies of one text of WINDOW words or more lose all of them.
    """
    n_parts = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("node", _node(F.col("text")))
    found = _anchor_rows(rows)
    place = F.xxhash64("node", "low")
    several = (
        found.groupBy("anchor").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
        .where("first != last").select("anchor", (F.col("n") > HOT).alias("hot"))
    )
    places = materialise(
        found.join(several, "anchor").groupBy("node").agg(F.collect_set(F.struct("low", "high", "anchor", "hot")).alias("places")), "anchors"
    )
    # One exchange of the distinct texts serves all three joins below; the filter, which joins would add to some of them
    # alone, keeps their plans equal.
    texts = rows.groupBy("node").agg(F.min("text").alias("text")).where(F.col("node").isNotNull())
    placed = texts.join(places, "node")
    answers = _streamed(_contexts(placed, True).repartition(n_parts, "shard"))
    spans = (
        _contexts(placed, False).join(answers, ["shard", "digest"])
        .select("node", F.explode(F.transform("starts", lambda s: s + F.col("low"))).alias("start"))
        .groupBy("node").agg(F.collect_set("start").alias("starts"))
    )
    cut = _cut(texts.join(spans, "node", "left").select("node", "text", "starts"))
    if not with_text:
        cut = cut.drop("kept")
    copies = rows.groupBy("node").agg(F.count("*").alias("n"))
    gone = (F.col("n") > 1) & (F.col("n_words") >= WINDOW)
    answered = cut.join(copies, "node").select(
        "node", "n_words", F.when(gone, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *[F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept")] * with_text,
    )
    return rows.select(F.col("id").alias(id_col), "node").join(answered, "node").drop("node")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
