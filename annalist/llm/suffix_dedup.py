"""Suffix-array deduplication of byte strings by a distributed, common-prefix-aware merge sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from annalist.llm.anchors import Occurrences, groups_of, identified, offsets_of, repeated_spans, with_spans
from annalist.llm.vectext import BYTE_CODE, covered, runs

#: Bytes of an anchor.
GRAM = 16


def byte_symbols(data: np.ndarray, offsets: np.ndarray):
    """Bytes of a block as symbols."""
    at = np.arange(len(data) + 1)
    return BYTE_CODE[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), data, at[:-1], at[1:], offsets[:-1]


def encode_suffixes(flat: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, i: np.ndarray):
    """A run: the segments sorted by what follows from their anchor on, that part front-coded, the part before it whole."""
    i = i[np.argsort((b - m)[i], kind="stable")]
    lens = (b - m)[i]
    width = int(lens.max())
    grid = m[i][:, None] + np.arange(width)
    inside = np.arange(width) < lens[:, None]
    grid = np.where(inside, flat[np.minimum(grid, len(flat) - 1)], 0).astype(np.uint8)
    order = np.argsort(np.ascontiguousarray(grid).view(f"S{width}")[:, 0], kind="stable")  # of equal ones the shorter is first
    i, grid, lens, inside = i[order], grid[order], lens[order], inside[order]
    differ = grid[1:] != grid[:-1]
    lcp = np.zeros(len(i), np.int64)
    lcp[1:] = np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(lens[1:], lens[:-1]))
    rest = grid[inside & (np.arange(width) >= lcp[:, None])].tobytes()
    left = (m - a)[i]
    off = offsets_of(left)
    pick = np.arange(off[-1]) - np.repeat(off[:-1], left) + np.repeat(a[i], left)
    return i, (lcp.astype(np.uint16), lens.astype(np.uint16), rest, left.astype(np.uint16), flat[pick].tobytes())


def decode_run(body: tuple, keep: np.ndarray) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Suffixes and left parts of the entries ``keep`` (ascending) and each one's common prefix with the one before."""
    lcp, lens, rest, fronts, left = body
    off = offsets_of(fronts)
    suffixes, cur, at = [], b"", 0
    wanted = np.zeros(len(lcp), bool)
    wanted[keep] = True
    for n, whole, want in zip(lcp.tolist(), lens.tolist(), wanted.tolist(), strict=True):
        cur = cur[:n] + rest[at : at + whole - n]
        at += whole - n
        if want:
            suffixes.append(cur)
    prefix = np.zeros(len(keep), np.int64)
    if len(keep) > 1:  # over entries that were left out the smallest common prefix counts
        prefix[1:] = np.minimum.reduceat(lcp[: keep[-1] + 1], keep[:-1] + 1)
    return suffixes, [left[off[k] : off[k + 1]] for k in keep.tolist()], prefix


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree on ``known`` bytes."""
    n = min(len(x), len(y))
    if x[known:n] == y[known:n]:
        return n
    d = int.from_bytes(x[known:n], "big") ^ int.from_bytes(y[known:n], "big")
    return known + (n - known) - (d.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of byte strings. Runs are lists of strings with each one's common prefix with the one before.

    A loser remembers its common prefix with the string it lost to. Of two candidates the one that has more in common with
    the last string output is the smaller; only if both have equally much are bytes compared, from there on. So bytes
    known to agree are never compared again.
    """

    def __init__(self, runs_: list[tuple[list[bytes], list[int]]]):
        self.runs = runs_
        self.size = 1 << max(0, len(runs_) - 1).bit_length()
        self.at = [0] * self.size
        self.lcp = [0] * self.size  # with the last output, or for losers with what they lost to
        self.loser = [-1] * self.size
        self.winner = self._build(1)

    def _head(self, r: int) -> bytes | None:
        if r < len(self.runs) and self.at[r] < len(self.runs[r][0]):
            return self.runs[r][0][self.at[r]]
        return None

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads; the loser's known prefix becomes that with the winner."""
        x, y = self._head(a), self._head(b)
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        n = common_prefix(x, y, self.lcp[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            self.lcp[b] = n
            return a, b
        self.lcp[a] = n
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        w, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return w

    def merge(self) -> Iterator[tuple[int, int, int]]:
        """Run, place in it, and common prefix with the string before, in sorted order."""
        while True:
            w = self.winner
            if self._head(w) is None:
                return
            yield w, self.at[w], self.lcp[w]
            self.at[w] += 1
            if self.at[w] < len(self.runs[w][0]):
                self.lcp[w] = self.runs[w][1][self.at[w]]
            node = (w + self.size) // 2
            while node:
                w, self.loser[node] = self._play(w, self.loser[node])
                node //= 2
            self.winner = w


def old_windows(size: int, fronts: list[bytes], windows: list[int], rank: list[int], shared: list[int]) -> list[tuple[int, int, int]]:
    """Windows of one anchor's segments that an earlier one has: segment, first and past-the-last window.

    Segments are in corpus order; ``rank`` is each one's place in the sorted order of what follows the anchor, ``shared`` the
    common prefix of each place with the place before. A window is ``n`` bytes before the anchor and ``size - n`` after it. The
    latter are equal for places between which no common prefix is shorter, so runs of places name them; the former likewise
    in the sorted order of the reversed parts before the anchor.
    """
    if len(fronts) == 2:
        before = common_prefix(fronts[0][::-1], fronts[1][::-1], 0)
        front, both = len(fronts[1]), [max(len(f) - w + 1, 0) for f, w in zip(fronts, windows, strict=True)]
        low = max(size - shared[1], *both)  # bytes before the anchor: so many that what follows is shared, and in both segments
        high = min(before, front)
        return [(1, front - high, front - low + 1)] if low <= high else []
    k = len(fronts)
    back = [f[::-1] for f in fronts]
    order = sorted(range(k), key=back.__getitem__)
    place = np.empty(k, np.int64)
    place[order] = np.arange(k)
    common = np.array([0, *(common_prefix(back[x], back[y], 0) for x, y in zip(order, order[1:], strict=False))])
    lens, wins = np.array([len(f) for f in fronts]), np.array(windows)
    n = np.arange(max(0, int((lens - wins).min()) + 1), int(lens.max()) + 1)
    left = np.cumsum(common[:, None] < n, axis=0)[place]
    right = np.cumsum(np.array(shared)[:, None] < size - n, axis=0)[np.array(rank)]
    inside = (n <= lens[:, None]) & (n > lens[:, None] - wins[:, None])
    ident = ((n * (k + 1) + left) * (k + 1) + right)[inside]
    known = np.ones(len(ident), bool)
    known[np.unique(ident, return_index=True)[1]] = False
    grid = np.zeros(inside.shape, bool)
    grid[inside] = known
    out = []
    for i in np.flatnonzero(grid.any(1)).tolist():
        for a, b in zip(*runs(grid[i]), strict=True):  # more bytes before the anchor is an earlier window
            out.append((i, int(lens[i] - n[b - 1]), int(lens[i] - n[a]) + 1))
    return out


def match_suffixes(size: int):
    """Windows of segments with equal anchors that an earlier segment has, by the merged order of their suffixes."""

    def detail(occ: Occurrences, bodies: list):
        left: list[bytes] = [b""] * len(occ.key)
        sorted_runs, owners = [], []
        for r in np.unique(occ.run):
            k = np.flatnonzero(occ.run == r)
            k = k[np.argsort(occ.at[k])]
            s, front, prefix = decode_run(bodies[r], occ.at[k])
            for j, y in zip(k.tolist(), front, strict=True):
                left[j] = y
            sorted_runs.append((s, prefix.tolist()))
            owners.append(k.tolist())
        place, shared = np.empty(len(occ.key), np.int64), []
        for r, at, n in LoserTree(sorted_runs).merge():
            place[owners[r][at]] = len(shared)
            shared.append(n)
        shared = np.array(shared)
        windows = occ.windows.tolist()
        seg, first, stop = [], [], []
        bounds = groups_of(occ.key)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            order = np.argsort(place[lo:hi])
            at = place[lo:hi][order]
            common = np.minimum.reduceat(shared[: at[-1] + 1], at[:-1] + 1).tolist()  # over other anchors' suffixes the least counts
            for i, a, b in old_windows(size, left[lo:hi], windows[lo:hi], np.argsort(order).tolist(), [0, *common]):
                seg.append(lo + i)
                first.append(a)
                stop.append(b)
        return np.array(seg, np.int64), np.array(first, np.int64), np.array(stop, np.int64)

    return detail


def suffix_dedup(docs: DataFrame, size: int = 100, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Remove bytes that lie in a ``size``-byte string which also starts earlier in the corpus.

    Texts are UTF-8 bytes; matches never cross documents. Earlier means in a document with a smaller id (null last), or in
    the same one at an earlier byte; strings are judged on the input. Ids that are no integers count in their order. Returns one row per input row: the id, ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` and, with ``texts``, ``kept`` (binary: a cut may split
    a character). Null and empty texts have no bytes. Different texts under one id are ordered by a hash; rows equal in id
    and text are one document and get the same result. An empty table gives an empty result; other columns are ignored.

    Of all suffixes only those that begin at an anchor are sorted (see :mod:`annalist.llm.anchors`): a repeated string holds
    the same anchor at the same place, so nothing is lost, and a suffix is sent no further than its windows reach. Tasks sort
    and front-code them; a shard's runs are merged by a loser tree that reuses the stored common prefixes, and the common
    prefixes of the merged order tell which strings are equal. Only copies inside one run, and windows at anchors with very many
    segments, are settled by hashes (of 128 and 96 bits).
    """
    rows = identified(docs, text_col, id_col)
    spans = repeated_spans(rows, size, GRAM, byte_symbols, encode_suffixes, match_suffixes(size))
    kind = docs.schema[id_col].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
            for text, ab in zip(batch.column(1), batch.column(2), strict=True):
                data = (text.as_py() or "").encode()
                left, a = data, ()
                if ab.is_valid:
                    v = np.asarray(ab.values)
                    mask = covered(v[::2], v[1::2], len(data))
                    a = runs(mask)[0]
                    left = np.frombuffer(data, np.uint8)[~mask].tobytes()
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(left))
                n_spans.append(len(a))
                sha.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(left)
            cols = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if texts else []), names)

    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if texts else [])
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    return with_spans(rows, spans).mapInArrow(finish, schema)
