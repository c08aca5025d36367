"""Benchmark decontamination by winnowed fingerprints that are extended to whole shared spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.vectext import ALNUM, Words, covered, runs, text_blocks
from annalist.plans.staging import stage

#: Benchmark text that one pass over the documents is matched with (its index has some ten times as many bytes); a larger
#: benchmark takes several passes.
PASS_BYTES = 8 << 20


class BenchmarkIndex:
    """Fingerprints of benchmark items, for one pass.

    Items of ``window`` words or more are winnowed: of each ``window - gram + 1`` consecutive ``gram``-word hashes the
    smallest is kept, so any shared run of ``window`` words shares a kept fingerprint at the same place in the run.
    Shorter items are one window each and are looked up by the hash of all their words. Hashes only propose: a window counts
    when its words are those of the item.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int, gram: int):
        self.window, self.gram = window, gram
        self.ids = np.array([i for i, _ in items], object)
        col = pa.array([t for _, t in items], pa.large_string())
        keys, spans, at, where = [], [], [], []
        short: dict[int, list[tuple[int, int, int]]] = {}
        self.words: list[bytes] = []
        for a, _, data, offsets in text_blocks(col, max(1, PASS_BYTES)):
            w = Words(data, offsets, ALNUM, lower=True)
            h = w.hashes()
            n = np.diff(w.first)
            for d in np.flatnonzero((n > 0) & (n < window)):
                k = int(n[d])
                short.setdefault(k, []).append((int(w.grams(h[w.first[d] : w.first[d] + k], k)[0]), a + int(d), len(self.words) + int(w.first[d])))
            g, big = w.grams(h, gram), w.grams(h, window)
            pos = np.flatnonzero(winnow(g, window - gram + 1) & w.whole(gram))
            whole = w.whole(window)
            for back in range(window - gram + 1):  # each window that holds the fingerprint, by how far into it that is
                s = pos - back
                ok = (s >= 0) & (s < len(big))
                ok[ok] = whole[s[ok]] & (w.doc[s[ok]] == w.doc[pos[ok]])
                keys.append(g[pos[ok]] + np.uint64(back))
                spans.append(big[s[ok]])
                at.append(a + w.doc[s[ok]])
                where.append(len(self.words) + s[ok])
            self.words += texts_of(w, np.arange(len(w.doc)))
        key, span, item, place = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, spans, at, where))
        order = np.lexsort((item, span, key))
        self.key, self.span, self.item, self.place = key[order], span[order], item[order].astype(np.int64), place[order].astype(np.int64)
        self.grams = np.unique(np.concatenate([self.key - np.uint64(b) for b in range(window - gram + 1)])) if len(key) else key
        self.short = {k: tuple(np.array(x, t) for x, t in zip(zip(*sorted(v), strict=True), (np.uint64, np.int64, np.int64), strict=True)) for k, v in short.items()}

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and item of every occurrence of a window in a block of texts."""
        h = w.hashes()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(self.key) and len(h) >= self.window:
            g, big, whole = w.grams(h, self.gram), w.grams(h, self.window), w.whole(self.window)
            pos = np.flatnonzero(winnow(g, self.window - self.gram + 1))
            pos = pos[_among(g[pos], self.grams)]
            for back in range(self.window - self.gram + 1):  # extend each fingerprint to the windows around it
                s = pos - back
                ok = (s >= 0) & (s < len(big))
                s, k = s[ok], g[pos[ok]] + np.uint64(back)
                inside = whole[s]
                s, k = s[inside], k[inside]
                at, item = _expand(self.key, self.item, k)
                same = self.span[item[1]] == big[s[at]]
                found.append(self._same(w, s[at[same]], self.window, item[0][same], self.place[item[1][same]]))
        for n, (hashes, item, place) in self.short.items():
            if len(h) >= n:
                s = np.flatnonzero(w.whole(n) & _among(w.grams(h, n), np.unique(hashes)))
                at, got = _expand(hashes, item, w.grams(h, n)[s])
                found.append(self._same(w, s[at], n, got[0], place[got[1]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _same(self, w: Words, s: np.ndarray, n: int, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the proposed windows whose words are the item's."""
        mine = {int(a): texts_of(w, np.arange(a, a + n)) for a in np.unique(s)}
        ok = np.array([mine[a] == self.words[p : p + n] for a, p in zip(s.tolist(), place.tolist(), strict=True)], bool)
        return s[ok], np.full(int(ok.sum()), n), item[ok]


def texts_of(w: Words, at: np.ndarray) -> list[bytes]:
    """Some words of a block."""
    return [w.data[a:b].tobytes() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]


def winnow(g: np.ndarray, width: int) -> np.ndarray:
    """Which hashes are the smallest (ties included) of some ``width`` consecutive ones."""
    m = len(g) - width + 1
    out = np.zeros(len(g), bool)
    if m <= 0:
        return out
    low = g[:m].copy()
    for j in range(1, width):
        np.minimum(low, g[j : j + m], out=low)
    for j in range(width):
        out[j : j + m] |= g[j : j + m] == low
    return out


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    i = np.searchsorted(table, x)
    i[i == len(table)] = 0
    return table[i] == x


def _expand(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For each entry of sorted ``keys`` equal to an ``x``: which ``x``, and the entry's value and place."""
    lo, hi = np.searchsorted(keys, x, "left"), np.searchsorted(keys, x, "right")
    n = hi - lo
    at = np.repeat(np.arange(len(x)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return at, (values[place], place)


def _passes(bench: DataFrame, item_col: str, text_col: str) -> tuple[int, Callable[[int], list[tuple[str | None, str]]]]:
    """How many passes the benchmark takes (none if it has no text), and what fetches the items of one."""
    items = bench.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = 1 + total // PASS_BYTES if total else 0
    return passes, lambda k: [(r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()]


def benchmark_overlap(
    docs: DataFrame, bench: DataFrame, window: int = 10, gram: int = 5,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Words of each document that lie in a benchmark window, and the items these come from.

    ASCII upper case is folded; words are runs of ASCII letters, digits and non-ASCII characters. A window is ``window``
    consecutive words of an item, or all of a shorter one. Returns one row per input row: the id, ``n_words``, ``n_hit``,
    ``items`` (sorted strings), ``spans`` (first and past-the-end word of each hit run) and the columns in ``keep`` (but for such of these names). Null
    and empty texts have no words, items without words have no window; words of an item with a null id are hit, but it has
    no id to be named by in ``items``; repeated rows stay rows; empty tables work.

    The benchmark is a stated query set: it travels to the executors in passes of ``PASS_BYTES``, one scan of the documents
    each, so its size is checked and not assumed; the driver holds one pass at a time. Usually that is one scan without any
    shuffle.
    """
    c = F.col
    keep = tuple(k for k in keep if k not in (id_col, "n_words", "n_hit", "items", "spans"))
    passes, items_of = _passes(bench, item_col, item_text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    extra = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    base = f"_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<a:long,b:long>>"
    schema = base + extra
    rows = docs.select(c(id_col).alias("_id"), c(text_col).alias("_text"), *[c(k) for k in keep])

    def matcher(index: BenchmarkIndex | None, carry: tuple[str, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, n_hit, items, spans = [], [], [], []
                for _, _, data, offsets in text_blocks(batch.column(1)):
                    w = Words(data, offsets, ALNUM, lower=True)
                    n_words.append(np.diff(w.first))
                    hit = np.zeros(w.n_docs, np.int64)
                    its: list[list[str]] = [[] for _ in range(w.n_docs)]
                    sps: list[list[dict]] = [[] for _ in range(w.n_docs)]
                    s, n, item = index.hits(w) if index else (np.zeros(0, np.int64),) * 3
                    if len(s):
                        mask = covered(s, s + n, len(w.doc))
                        hit = np.bincount(w.doc[mask], minlength=w.n_docs)
                        for d, i in sorted(set(zip(w.doc[s].tolist(), item.tolist(), strict=True))):
                            its[d] += [index.ids[i]] if index.ids[i] is not None else []
                        mark = np.unique(np.concatenate([runs(mask)[0], w.first[:-1][np.isin(w.first[:-1], np.flatnonzero(mask))]]))
                        for a in mark.tolist():
                            d = int(w.doc[a])
                            stop = int(w.first[d + 1])
                            gap = np.flatnonzero(~mask[a:stop])
                            sps[d].append({"a": a - int(w.first[d]), "b": (a + int(gap[0]) if len(gap) else stop) - int(w.first[d])})
                    n_hit.append(hit)
                    items += [sorted(set(x)) for x in its]
                    spans += sps
                cols = [
                    batch.column(0), pa.array(np.concatenate(n_words or [np.zeros(0, np.int64)]), pa.int64()), pa.array(np.concatenate(n_hit or [np.zeros(0, np.int64)]), pa.int64()),
                    pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), *[batch.column(2 + k) for k in range(len(carry))],
                ]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "n_words", "n_hit", "items", "spans", *carry])

        return run

    if passes < 2:
        index = BenchmarkIndex(items_of(0), window, gram) if passes else None
        return rows.mapInArrow(matcher(index, keep), schema).withColumnRenamed("_id", id_col)
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    every = None
    for k in range(passes):
        found = rows.select("_id", "_text", "_row").mapInArrow(matcher(BenchmarkIndex(items_of(k), window, gram), ("_row",)), f"{base}, _row long")
        found = stage(found if every is None else found.filter("n_hit > 0"), "hits")  # the first pass tells every row's words
        every = found if every is None else every.unionByName(found)
    lone = every.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("_s"))
    merge = (
        "aggregate(_s, cast(array() as array<struct<a:bigint,b:bigint>>), (m, s) -> if(size(m) > 0 and element_at(m, -1).b >= s.a, "
        "concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, s.b)))), concat(m, array(s))))"
    )
    lone = lone.withColumn("spans", F.expr(merge)).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.b - s.a)"))
    return lone.join(rows.drop("_id", "_text"), "_row").select(c("_id").alias(id_col), "n_words", "n_hit", "items", "spans", *keep)


def items_digest() -> Column:
    """SHA-256 of the column ``items``, joined by commas."""
    return F.sha2(F.array_join("items", ","), 256)
