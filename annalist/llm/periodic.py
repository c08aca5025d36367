"""Runs of periodically repeated words: only words inside repeated k-grams can join one, the rest is never searched."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD, _ODD_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def repeated_length(least: int, exponent: int) -> int:
    """Words that a run of period q shares with itself moved by q, at least: the smallest max(least, exponent * q) - q over all q.

    Below least / exponent that falls with q, above it grows, so one of the two periods next to it has the smallest.
    """
    return min(max(least, exponent * q) - q for q in {max(1, least // exponent), -(-least // exponent)})


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, ``n`` at least; kept by this process."""
    for i, base in enumerate((_ODD, _ODD_INVERSE)):
        while len(_powers[i]) < n:
            t = _powers[i]
            step = np.uint64(pow(base, len(t), 1 << 64))
            _powers[i] = np.concatenate([t, t * step])
    return _powers[0][:n], _powers[1][:n]


def repeated_stretches(ids: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` words that repeated ``k``-grams cover, as start and end.

    Equal grams have equal hashes; unequal ones that collide only leave a word that is then searched in vain.
    """
    n = len(ids)
    if n < max(k + 1, least):
        return []
    up, down = _power_table(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > k)
    starts, ends = at[np.r_[0, gap + 1]], at[np.r_[gap, len(at) - 1]] + k
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a >= least]


def _z(s: Sequence[int]) -> list[int]:
    """Length of the longest common prefix of ``s`` and each of its suffixes."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def main_lorentz(s: list[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """Maximal runs of ``s`` with a length of at least ``least`` and of ``exponent`` (2 or more) smallest periods: start, length, period,
    by start and period.

    Halves the sequence again and again. A run that holds the middle of a piece has a whole period on one of its sides; for
    each period the words that agree to both sides of the place one period away follow from four prefix tables. A run that
    ends at the border of a piece and goes on beyond is found whole in a larger piece.
    """
    found: dict[tuple[int, int], int] = {}
    n, todo = len(s), [(0, len(s))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        mid, most = (lo + hi) // 2, (hi - lo) // exponent
        todo += [(lo, mid), (mid, hi)]
        left, right = s[lo:mid], s[mid:hi]
        back = left[::-1]
        forth_of_right, back_of_left = _z(right), _z(back)
        q_right, q_left = min(most, len(right)), min(most, len(left))
        over = _z([*back, -1, *s[lo : mid + q_right][::-1]])  # suffixes of the left half against those that end up to q later
        under = _z([*right, -1, *s[mid - q_left : hi]])  # prefixes of the right half against those that start up to q earlier
        size_left, size_right = len(left), len(right)
        for q in range(1, q_right + 1):
            b = over[size_left + 1 + q_right - q]
            f = forth_of_right[q] if q < size_right else 0
            if b + f + q >= least and b + f + q >= exponent * q:
                _keep(found, s, n, mid - b, mid + q + f, q)
        for q in range(1, q_left + 1):
            f = under[size_right + 1 + q_left - q]
            b = back_of_left[q] if q < size_left else 0
            if b + f + q >= least and b + f + q >= exponent * q:
                _keep(found, s, n, mid - q - b, mid + f, q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _keep(found: dict[tuple[int, int], int], s: list[int], n: int, a: int, b: int, q: int) -> None:
    """Record a stretch with period ``q`` if no neighbour extends it, under its smallest period."""
    if (a and s[a - 1] == s[a - 1 + q]) or (b < n and s[b] == s[b - q]):
        return
    found[a, b] = min(q, found.get((a, b), q))


def runs_of(words: Sequence[str], least: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """All runs of ``words``: start, length and smallest period, by start and period."""
    k = repeated_length(least, exponent)
    if len(words) < least:
        return []
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    return [(a + x, size, q) for a, b in repeated_stretches(np.array(ids), k, least) for x, size, q in main_lorentz(ids[a:b], least, exponent)]


def collapse(words: Sequence[str], runs: Sequence[tuple[int, int, int]]) -> Sequence[str]:
    """``words`` without those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for a, size, q in runs:
        gone[a + q : a + size] = True
    return [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


def periodic_runs(docs: DataFrame, least: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find stretches of words that repeat with a period, and the text without the repetitions.

    Returns one row per input row: the id, ``runs`` (``array<struct<start,length,period>>`` in words, by start and period) and
    ``collapsed`` (the kept words joined by one blank). A run is a stretch of at least ``least`` words and ``exponent`` times its
    smallest period that no neighbouring word extends; of each run only the first period is kept, but for words that another
    run drops. Null and empty texts have no words and no runs; repeated rows are treated one by one; an empty table gives an
    empty result; other columns are ignored.

    Scale: each row is handled by itself, and nothing is shuffled. A run's words lie in grams of :func:`repeated_length` words
    that occur twice in the document, so all others are ruled out by a sort of hashes; what is left is searched in n log n steps.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = [], []
            for text in batch.column(1).to_pylist():
                words = WORD.findall(text or "")
                own = runs_of(words, least, exponent)
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in own])
                kept.append(" ".join(collapse(words, own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(run)), pa.array(kept, pa.string())], ["id", "runs", "collapsed"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(find, f"id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
