"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text state machine.

The merge list alone says how far to the right of a place the text can still decide whether a token ends there:
:func:`sufficient_lookahead`.  A pre-token is read through a buffer; tokens that end at least that far before the end of
the buffer are final and leave it.  Texts are split a segment at a time, and ids and bytes go on to their digests and to the
decoder as they come, so beside the text itself (and the columns that are to hold its ids or its decoded text) memory does
not depend on its length.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read

TOKENIZER = "byte_bpe_50k.json"
# Bytes of a pre-token held beyond the lookahead; cached pre-tokens per Python worker, and their length.
BUFFER = 2048
CACHED = 250_000
CACHED_LENGTH = 64
# Characters split into pre-tokens at a time, and rows encoded at a time.
SEGMENT = 65_536
ROWS = 500

# White space of Unicode, and the pattern that splits text before merges.
_BLANK = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
# The same for texts of Latin-1 characters only, where the plain engine knows all letters and numbers.
_LETTER, _NUMBER = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼-¾"
LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+"
    rf"|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[int, int, int]], sizes: list[int]) -> int:
    """Bytes to the right of a place beyond which no text changes whether a token ends there.

    ``merges`` has (left, right, made) in order of rank.  What stands left of a place is changed from the right only by a
    merge whose left part is a token on the right spine of what stands there, made before that part is used up.  Whether
    its right part is formed depends in turn on merges of still lower rank at its own right edge.  Ranks fall along such
    a chain, so the longest chain is found in one pass over the ranks; its bytes are the bound.
    """
    made_by = {made: rank for rank, (_, _, made) in reversed(list(enumerate(merges)))}
    reach_of: dict[int, tuple[list[int], list[int]]] = {}  # of a left part: ranks, longest reach up to each

    def reach(token: int, below: int) -> int:
        best = 0
        while True:
            ranks, longest = reach_of.get(token, ((), ()))
            i = bisect_left(ranks, below)
            if i:
                best = max(best, longest[i - 1])
            rank = made_by.get(token)
            if rank is None:
                return best
            below, token = min(below, rank), merges[rank][1]

    most = 0
    for rank, (left, right, _) in enumerate(merges):
        length = sizes[right] + reach(right, rank)
        ranks, longest = reach_of.setdefault(left, ([], []))
        ranks.append(rank)
        longest.append(max(length, longest[-1] if longest else 0))
        most = max(most, length)
    return most


class Bpe:
    """Encoder and decoder of one vocabulary file; added tokens in a text are recognised as the file says."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        to_byte = {c: b for b, c in letters.items()}
        self.bytes_of: dict[int, bytes] = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        listed = []
        for rank, (a, b) in enumerate(pairs):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merge[left, right] = (rank, made)
            listed.append((left, right, made))
        self.rank = {pair: rank for pair, (rank, _) in self.merge.items()}
        self.made = [made for _, _, made in listed]
        self.no_rank = len(listed)
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        # Tokens that merging can reach, by their bytes; all endings of such tokens, with the token if one is a token itself.
        self.token_of = {bytes([b]): i for b, i in enumerate(self.of_byte)}
        self.token_of |= {self.bytes_of[i]: i for i in self.made if self.merge_all(self.bytes_of[i]) == [i]}
        self.endings = {data[i:]: -1 for data in self.token_of for i in range(len(data))} | self.token_of
        self.pairs: dict[tuple[int, int], bool] = {}
        sizes = [0] * (max(vocab.values()) + 1)
        for i, data in self.bytes_of.items():
            sizes[i] = len(data)
        self.lookahead = sufficient_lookahead(listed, sizes)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.bytes_of |= {i: content.encode() for content, i in self.added.items()}
        self.split_added = (
            regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        )
        self.pattern = regex.compile(PATTERN)
        self.digits = {i: str(i) for i in self.bytes_of}
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def merge_all(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost first, until no pair merges."""
        ids: list[int] = [self.of_byte[b] for b in data]
        merge = self.merge
        if len(ids) <= 64:
            rank_of, none = self.rank, self.no_rank
            ranks = [rank_of.get(pair, none) for pair in zip(ids, ids[1:])]
            while ranks:
                rank = min(ranks)
                if rank == none:
                    break
                at = ranks.index(rank)
                ids[at : at + 2] = [self.made[rank]]
                del ranks[at]
                if at:
                    ranks[at - 1] = rank_of.get((ids[at - 1], ids[at]), none)
                if at < len(ranks):
                    ranks[at] = rank_of.get((ids[at], ids[at + 1]), none)
            return ids
        n = len(ids)
        following, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(f[0], i, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = following[i] if alive[i] else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], following[i] = made, False, following[j]
            if following[j] < n:
                before[following[j]] = i
                if f := merge.get((made, ids[following[j]])):
                    heapq.heappush(queue, (f[0], i, made, ids[following[j]], f[1]))
            if (b := before[i]) >= 0 and (f := merge.get((ids[b], made))):
                heapq.heappush(queue, (f[0], b, ids[b], made, f[1]))
        return [t for t, here in zip(ids, alive) if here]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stand side by side when their bytes alone are encoded."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= 4 * CACHED:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merge_all(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def forward(self, data: bytes) -> list[int]:
        """The same tokens as :meth:`merge_all`, in one pass over the bytes that never goes back.

        The state is the last token of every beginning of the bytes.  Of the tokens that end at a place just one fits the
        last token of what stands before it, so each place is settled when its byte is read; which of the places are
        boundaries shows at the end, from the last one backwards.
        """
        whole = self.token_of.get(data)
        if whole is not None:
            return [whole]
        endings, pairs, fits, last = self.endings, self.pairs, self.fits, [-1]
        for end in range(1, len(data) + 1):
            start = end - 1
            while True:
                token = endings[data[start:end]]
                if token >= 0:
                    if not start:
                        break
                    fit = pairs.get((last[start], token))
                    if fit or fit is None and fits(last[start], token):
                        break
                start -= 1
            last.append(token)
        made, place = [], len(data)
        while place:
            made.append(last[place])
            place -= len(self.bytes_of[last[place]])
        return made[::-1]

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in parts, each as soon as no later byte can change it.

        At most BUFFER bytes and the lookahead are held, beside the part that arrives.
        """
        held = b""
        for part in parts:
            held += part
            if len(held) >= self.lookahead + BUFFER:
                final, done = len(held) - self.lookahead, 0
                for token in self.forward(held):
                    if done + len(self.bytes_of[token]) > final:
                        break
                    done += len(self.bytes_of[token])
                    yield token
                held = held[done:]
        yield from self.forward(held)

    def _told(self, ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), ",".join([self.digits[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])

    def _pre_token(self, text: str) -> tuple[int, str, bytes]:
        data = text.encode()
        made = self._told(list(self.stream([data])))
        if len(data) <= CACHED_LENGTH:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[text] = made
        return made

    def _long(self, text: str) -> Iterator[list[tuple[int, str, bytes]]]:
        """A pre-token longer than a segment, a few thousand tokens at a time."""
        ids = self.stream(text[i : i + BUFFER].encode() for i in range(0, len(text), BUFFER))
        while held := list(islice(ids, BUFFER)):
            yield [self._told(held)]

    def _plain(self, text: str, place: int, stop: int) -> Iterator[list[tuple[int, str, bytes]]]:
        """Pre-tokens from ``place`` to ``stop``, a segment at a time.

        What the end of a segment may have cut, its last two pre-tokens, is read again with the next segment.  A segment
        that is hardly more than that grows.
        """
        known, made, size = self.known.get, self._pre_token, SEGMENT
        while place < stop:
            end = min(place + size, stop)
            segment = text[place:end]
            parts = (LATIN if _is_latin(segment) else self.pattern).findall(segment)
            cut = 0
            if end < stop:
                cut = sum(map(len, parts[-2:]))
                if 2 * cut > len(segment):
                    size *= 2
                    continue
                del parts[-2:]
            place, size = end - cut, SEGMENT
            if len(segment) > SEGMENT:  # holds a pre-token of that size
                for part in parts:
                    if len(part) > SEGMENT // 4:
                        yield from self._long(part)
                    else:
                        yield [known(part) or made(part)]
            else:
                yield [known(part) or made(part) for part in parts]

    def chunked(self, text: str) -> Iterator[list[tuple[int, str, bytes]]]:
        """The text's pre-tokens in order, some at a time, as (number of ids, ids in decimal, bytes that the ids stand for)."""
        place = 0
        for found in self.split_added.finditer(text) if self.split_added else ():
            yield from self._plain(text, place, found.start())
            yield [self._told([self.added[found[0]]])]
            place = found.end()
        yield from self._plain(text, place, len(text))

    def encode(self, text: str) -> list[int]:
        return [int(i) for some in self.chunked(text) for _, ids, _ in some for i in ids.split(",")]

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(text_of(self.bytes_of[i] for i in ids))


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def text_of(parts: Iterable[bytes]) -> Iterator[str]:
    """Text as its bytes arrive: a character split between parts is held until whole; what is no UTF-8 becomes U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
    for part in parts:
        yield machine.decode(part)
    yield machine.decode(b"", final=True)


_HELD: dict[str, Bpe] = {}


def load(file: str) -> Bpe:
    """The vocabulary, once per Python worker."""
    if file not in _HELD:
        _HELD[file] = Bpe(file)
    return _HELD[file]


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_table(docs: DataFrame, file: str | None = None, text_col: str = "text", name: str = TOKENIZER, round_trip: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``token_ids``; columns of these names are replaced.

    Null counts as the empty text: no tokens, digests of the empty string.  ``file`` is the vocabulary on each executor;
    without it the file ``name`` of the installed package is taken.  With ``round_trip`` the text column holds the
    decoded text (null stays null).  No shuffle; a worker holds one batch and two bounded caches.
    """
    made = ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")
    return _encoded(docs.drop(*made), file, text_col, name, round_trip, keep_ids=True)


def _encoded(docs: DataFrame, file, text_col: str, name: str, round_trip: bool, keep_ids: bool) -> DataFrame:
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
        + ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["token_ids array<int>"] * keep_ids
    )
    held = list(docs.columns)
    place = held.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file or vocabulary_path(name))
        # A few rows at a time: ids and decoded texts take several times the room of the texts.
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            counts, ids_digest, text_digest, all_ids, texts = [], [], [], [], []
            for text in batch.column(place):
                value = text.as_py()
                total, listed, digest, decoded, held_ids = 0, hashlib.sha256(), hashlib.sha256(), [], []

                def parts() -> Iterator[bytes]:
                    nonlocal total
                    for some in bpe.chunked(value or ""):
                        ids = ",".join([c[1] for c in some])
                        listed.update(f",{ids}".encode() if total else ids.encode())
                        total += sum([c[0] for c in some])
                        if keep_ids:
                            held_ids.append(np.fromstring(ids, dtype=np.int32, sep=","))
                        yield b"".join([c[2] for c in some])

                for part in text_of(parts()):
                    digest.update(part.encode())
                    if round_trip:
                        decoded.append(part)
                counts.append(total)
                ids_digest.append(listed.hexdigest())
                text_digest.append(digest.hexdigest())
                if keep_ids:
                    all_ids.append(np.concatenate(held_ids) if held_ids else np.zeros(0, np.int32))
                if round_trip:
                    texts.append(None if value is None else "".join(decoded))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            if round_trip:
                columns[place] = pa.array(texts, pa.string())
            columns += [pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*held, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * keep_ids])

    return docs.mapInArrow(run, schema)


def token_digests(docs: DataFrame, file: str | None = None, text_col: str = "text", name: str = TOKENIZER) -> DataFrame:
    """As :func:`encode_table`, without the ids themselves and without the text."""
    return _encoded(docs.drop("n_tokens", "ids_sha256", "decoded_sha256"), file, text_col, name, False, keep_ids=False).drop(text_col)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read(spark, sf_dir, "documents").select("doc_id", "text"))
