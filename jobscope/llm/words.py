"""Words and their hashes for whole batches of texts, as numpy over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xD1342543DE82EF95)
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

# Word bytes: letters of ASCII and everything outside ASCII; or all but blanks.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[48:58] = True
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _POWERS.get(int(base))
    if held is None or len(held[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        held = tuple(
            np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, _inverse(base))
        )
        if size <= 4 * PIECE_BYTES:
            _POWERS[int(base)] = held
    return held


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Piece(NamedTuple):
    """Some rows of a batch: rows ``first`` … ``first + n - 1``, their bytes, and where each row starts and ends."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """``start`` and ``end`` of each word in the bytes, ``hash``, and ``first[i]``, the number of words before row i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """The rows of a string column in pieces of about ``size`` bytes; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield Piece(first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def fold(piece: Piece) -> Piece:
    """The bytes with A-Z and the capital letters of Latin-1 in lower case."""
    data = piece.data.copy()
    capital = (data >= 65) & (data <= 90)
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    capital |= after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    data[capital] += 32
    return piece._replace(data=data)


def words(piece: Piece, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of a kind, inside rows."""
    data, offsets = piece.data, piece.offsets
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(piece.n + 1, np.int64))
    inside = kind[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = _powers(_BASE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_RANDOM[data] * power[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * inverse[start])
    return Words(start, end, hashed, np.searchsorted(start, offsets).astype(np.int64))


def windows(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that begin at each word; shorter by ``size - 1`` than the words."""
    n = len(hashed)
    if n < size:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(_BASE2, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashed * power[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse[: n - size + 1])


def window_rows(found: Words, size: int) -> np.ndarray:
    """Which window starts stay inside their row, for the windows of :func:`windows`."""
    n = len(found.hash)
    if n < size:
        return np.zeros(0, dtype=bool)
    ends = np.repeat(found.first[1:], np.diff(found.first))
    return np.arange(n - size + 1) + size <= ends[: n - size + 1]
