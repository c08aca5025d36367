"""Whole Arrow batches of text as flat numpy arrays: bytes, words and hashes of word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at a time; a single longer text is one block.
BLOCK_BYTES = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of a word: all but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of a word: ASCII digits and letters and all of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + _MIX
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit number for each byte.
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[a, b)`` of a text column at a time with their UTF-8 bytes and ``b - a + 1`` offsets. Null is empty."""
    col = column.fill_null("") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(off, width, n + 1, col.offset * np.dtype(width).itemsize).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + block_bytes, "right")) - 1)
        yield a, b, flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """Words of a block of texts: byte ranges, the text each is in, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool):
        self.data = ASCII_LOWER[data] if lower else data
        self.n_docs = len(offsets) - 1
        inside = kind[self.data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends where its text ends
        begin[edge] = inside[edge]
        stop[edge - 1] = inside[edge - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))  # index of each text's first word
        self._inside = inside

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        at = np.flatnonzero(self._inside)
        lens = self.end - self.start
        first = np.concatenate([[0], np.cumsum(lens)[:-1]])
        pos = np.arange(len(at)) - np.repeat(first, lens)
        h = np.add.reduceat(BYTE_CODE[self.data[at]] * powers(int(lens.max()))[pos], first)
        return mix64(h + lens.astype(np.uint64))

    def grams(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """A hash of each ``n`` consecutive words; entries that cross into the next text are not masked."""
        m = len(hashes) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        p = powers(n)
        g = np.zeros(m, np.uint64)
        for j in range(n):
            g += hashes[j : j + m] * p[j]
        return mix64(g)

    def whole(self, n: int) -> np.ndarray:
        """Whether each run of ``n`` words lies in one text."""
        m = len(self.doc) - n + 1
        return self.doc[:m] == self.doc[n - 1 :] if m > 0 else np.zeros(0, bool)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in any of the ranges."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true ranges of ``mask``."""
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
