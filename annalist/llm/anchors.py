"""Repeated windows of long sequences, found through content-defined anchors.

A window is ``size`` consecutive symbols (words or bytes) of one text. Of the ``gram``-symbol hashes inside a window the
smallest, leftmost on ties, is its anchor. Equal windows have equal anchors at the same place, so only windows with equal
anchors need ever meet. Consecutive windows mostly share their anchor; such a run is a *segment*: the symbols from its first
window's start to its last window's end. Segments go to a shard by their anchor's hash; a shard is a bounded part of the
corpus that one task handles.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from annalist.llm.filters import maybe_in
from annalist.llm.vectext import mix64, powers, text_blocks
from annalist.plans.numbering import numbered
from annalist.plans.staging import stage

#: Text that a task turns into one sorted run per shard.
RUN_BYTES = 24 << 20
#: Packed segments of a text's byte, at most; and how many of their bytes a task reads, in how many shards.
SEGMENTS_PER_TEXT, TASK_BYTES, SHARDS_PER_TASK = 3.5, 64 << 20, 4
#: Segments of one anchor that may meet in one shard; an anchor with more has its windows sent singly.
HOT_BYTES = 4 << 20
#: Text that such anchors are looked for in (a ten-thousandth of a larger corpus), and the least sightings of one.
SAMPLE_BYTES, LEAST_SEEN = 64 << 20, 16
#: Windows whose anchors are found at a time.
CHUNK = 1 << 21
_AT = np.uint64((1 << 24) - 1)


def gram_hashes(code: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive symbols, ``n`` a power of two."""
    g, width = code, 1
    while width < n:
        if len(g) <= width:
            return np.zeros(0, np.uint64)
        g = g[:-width] * powers(width + 1)[width] + g[width:]
        width *= 2
    return mix64(g)


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (leftmost on ties in the upper 40 bits) of each ``width`` consecutive numbers."""
    n = len(x) - width + 1
    key = (x & ~_AT) | np.arange(len(x), dtype=np.uint64)
    pad = -len(x) % width
    if pad:
        key = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)])
    rows = key.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & _AT).astype(np.int64)


@dataclass
class Segments:
    """Segments of a block: anchor hash, text, anchor's place, first and past-the-last window start (places in the block)."""

    key: np.ndarray
    doc: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    stop: np.ndarray


def find_segments(code: np.ndarray, doc: np.ndarray, size: int, gram: int) -> Segments:
    """Segments of a block of symbols; ``doc`` is the text of each symbol, ascending."""
    parts = []
    for at in range(0, max(0, len(code) - size + 1), CHUNK):
        c, d = code[at : at + CHUNK + size - 1], doc[at : at + CHUNK + size - 1]
        n = len(c) - size + 1
        if n <= 0:
            break
        g = gram_hashes(c, gram)
        p = sliding_argmin(g, size - gram + 1)[:n]
        valid = d[:n] == d[size - 1 :]
        new = np.ones(n, bool)
        new[1:] = (p[1:] != p[:-1]) | ~valid[:-1]
        s = np.flatnonzero(new & valid)
        end = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]])) + 1
        parts.append((g[p[s]], d[s], p[s] + at, s + at, end + at))
    if not parts:
        return Segments(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    return Segments(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def range_hashes(code: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the symbols of each range: its polynomial, from prefix sums, and its length."""
    base = np.uint64(0x9E3779B97F4A7C55)
    n = len(code) + 1
    up = np.full(n, base, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(n, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    total = np.zeros(n, np.uint64)
    np.add.accumulate(code * up[:-1], out=total[1:])
    h = (total[stop] - total[start]) * down[start]
    return mix64(h + mix64((stop - start).astype(np.uint64)))


def pack(parts: tuple) -> bytes:
    """A compressed row of arrays."""
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, protocol=5))


def unpack(blob: bytes) -> tuple:
    """What :func:`pack` was given."""
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def by_digit(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^32 as four rows of bytes, which compress better than whole numbers."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def from_digits(rows: np.ndarray) -> np.ndarray:
    """What :func:`by_digit` was given."""
    return np.ascontiguousarray(rows.T).view("<u4")[:, 0].astype(np.int64)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Starts of consecutive pieces, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


@dataclass
class Occurrences:
    """Segments of a shard, from all runs, with their texts' identities."""

    key: np.ndarray
    content: np.ndarray
    doc: np.ndarray
    text_hash: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    run: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, runs: list[tuple]) -> Occurrences:
        """Those of unpacked runs."""
        back = [from_digits(r[4]) for r in runs]
        lens = [len(r[0]) for r in runs]
        return cls(
            np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]), np.concatenate([r[2][k] for r, k in zip(runs, back, strict=True)]), np.concatenate([r[3][k] for r, k in zip(runs, back, strict=True)]),
            np.concatenate([from_digits(r[5]) for r in runs]), np.concatenate([r[6] for r in runs]).astype(np.int64), np.repeat(np.arange(len(runs)), lens), np.concatenate([np.arange(x) for x in lens]),
        )

    def take(self, i: np.ndarray) -> Occurrences:
        """Some of them."""
        return Occurrences(*(v[i] for v in vars(self).values()))

    def shared(self) -> Occurrences:
        """Those whose key another one has too, in order of key and position, a place of a repeated row once."""
        order = np.lexsort((self.first, self.text_hash, self.doc, self.key))
        o = self.take(order)
        same = o.key[1:] == o.key[:-1]
        again = same & (o.doc[1:] == o.doc[:-1]) & (o.text_hash[1:] == o.text_hash[:-1]) & (o.first[1:] == o.first[:-1])
        o = o.take(np.concatenate([[True], ~again]))
        same = o.key[1:] == o.key[:-1]
        return o.take(np.concatenate([same, [False]]) | np.concatenate([[False], same]))


def _span_batch(doc: np.ndarray, text_hash: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """One row per text with its ranges, joined where they touch, as a flat list of starts and ends."""
    if len(doc):
        order = np.lexsort((a, text_hash, doc))
        doc, text_hash, a, b = doc[order], text_hash[order], a[order], b[order]
        other = np.ones(len(doc), bool)
        other[1:] = (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1])
        group = np.cumsum(other) - 1
        far = np.int64(1) << 40  # texts far apart on one line, so that one running maximum serves all
        reach = np.maximum.accumulate(b + group * far)
        new = other.copy()
        new[1:] |= a[1:] + group[1:] * far > reach[:-1]
        at = np.flatnonzero(new)
        last = np.concatenate([at[1:], [len(doc)]]) - 1
        a, b, doc, text_hash, other = a[at], reach[last] - group[last] * far, doc[at], text_hash[at], other[at]
        rows = np.flatnonzero(other)
        flat = np.stack([a, b], axis=1).ravel()
        offsets = np.concatenate([2 * rows, [len(flat)]]).astype(np.int32)
        doc, text_hash = doc[rows], text_hash[rows]
    else:
        flat, offsets = np.zeros(0, np.int64), np.zeros(1, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
    null = doc == np.iinfo(np.int64).max
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=null), pa.array(text_hash, pa.int64()), lists], ["doc_id", "th", "ab"])


def first_and_later(key: np.ndarray, content: np.ndarray, doc: np.ndarray, text_hash: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal segments, the first one's index, and the indices of those that begin elsewhere.

    A repeated row brings the same segment of the same text again; that is neither.
    """
    order = np.lexsort((first, text_hash, doc, content, key))
    same = np.zeros(len(order), bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    elsewhere = (doc[order] != doc[head]) | (text_hash[order] != text_hash[head]) | (first[order] != first[head])
    return order[~same], order[same & elsewhere]


Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def frequent_anchors(rows: DataFrame, size: int, gram: int, symbols: Symbols, total: int) -> np.ndarray:
    """Anchors whose segments would make up more than ``HOT_BYTES``, by a sample of the texts.

    They only decide how windows are sent, not what is found. As the least size of such an anchor grows with the corpus
    there are at most some 100,000 of them.
    """
    share = min(1.0, max(SAMPLE_BYTES / max(total, 1), 1e-4))
    most = max(HOT_BYTES, total // 10**5)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lens = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                code, doc, _, sa, sb, _ = symbols(data, offsets)
                seg = find_segments(code, doc, size, gram)
                keys.append(seg.key)
                lens.append(sb[seg.stop - 2 + size] - sa[seg.first] if len(seg.key) else lens[0])
        key, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        held = np.bincount(at, np.concatenate(lens), len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key[n > 1].view(np.int64)), pa.array(n[n > 1], pa.int64()), pa.array(held[n > 1])], ["key", "n", "held"])

    texts = rows.select(F.coalesce("text", F.lit("")).alias("text"))
    found = (texts.sample(share, 11) if share < 1 else texts).mapInArrow(count, "key long, n long, held long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    return np.sort(np.array([r["key"] for r in found.filter((F.col("n") >= LEAST_SEEN) & (F.col("held") > most * share)).select("key").collect()], np.int64).view(np.uint64))


def single_windows(seg: Segments, hot: np.ndarray, code: np.ndarray, size: int) -> tuple[Segments, Segments]:
    """Segments of other anchors, and the windows of those with hot ones, each under a second hash of its own content."""
    if not len(hot) or not len(seg.key):
        return seg, Segments(*(v[:0] for v in vars(seg).values()))
    is_hot = hot[np.minimum(np.searchsorted(hot, seg.key), len(hot) - 1)] == seg.key
    n = (seg.stop - seg.first)[is_hot]
    at = np.repeat(seg.first[is_hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    key = range_hashes(mix64(code), at, at + size)
    lone = Segments(key, np.repeat(seg.doc[is_hot], n), at, at, at + 1)
    return Segments(*(v[~is_hot] for v in vars(seg).values())), lone


def repeated_spans(docs: DataFrame, size: int, gram: int, symbols: Symbols, encode: Callable, detail: Callable, shards: int | None = None) -> DataFrame:
    """Ranges of symbols covered by windows that also start earlier, one row per text that has any.

    ``docs`` has ``doc_id`` (long), ``text``, ``th`` (a hash of the text; with the id it names a text). ``symbols`` turns a
    block's bytes and offsets into symbol codes, their texts, the bytes to be sent and each symbol's first and past-the-end
    byte there, and first symbols of texts. ``encode`` makes the body of a run from the kept segments' bytes; ``detail``
    gets a shard's runs and its segments that share an anchor, in order of anchor and position, and yields which of their
    windows occurred earlier. Result: ``doc_id``, ``th``, ``ab`` (starts and ends in turn).

    Inside a run all but the first of equal segments are settled on the spot, so a passage that a third of all texts share
    reaches its shard once per run, not once per text. An anchor with very many different segments (a passage in ever new
    surroundings) would still make a large shard: its windows are sent one by one, each to the shard of its own hash, as
    hashes of 96 bits without text, so its work is spread. Shards are cut by the size of the corpus.
    """
    spark = docs.sparkSession
    top = np.iinfo(np.int64).max
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * SEGMENTS_PER_TEXT / TASK_BYTES))
    n = shards or SHARDS_PER_TASK * parts
    hot = frequent_anchors(docs, size, gram, symbols, total)

    def flush(blocks: list, ids: list, hashes: list) -> Iterator[tuple[int, bytes]]:
        """Sorted runs, up to two per shard, and the spans that settle themselves here."""
        doc, th = np.concatenate(ids), np.concatenate(hashes)
        key, content, of, first, windows, lone = (np.concatenate([b[j] for b in blocks]) for j in range(6))
        base = np.cumsum([0, *[len(b[6]) for b in blocks]])
        flat = np.concatenate([b[6] for b in blocks])
        ca, cm, cb = (np.concatenate([b[j] + base[i] for i, b in enumerate(blocks)]) for j in (7, 8, 9))
        keep, twice = first_and_later(key, content, doc[of], th[of], first)
        yield -1, (doc[of[twice]], th[of[twice]], first[twice], first[twice] + windows[twice] - 1 + size)
        shard = 2 * ((key[keep] >> np.uint64(20)) % np.uint64(n)).astype(np.int64) + lone[keep]
        by = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[by], np.arange(2 * n + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            i, body = keep[by[edges[s] : edges[s + 1]]], None
            if s % 2 == 0:
                i, body = encode(flat, ca, cm, cb, i)
            d, back = np.unique(of[i], return_inverse=True)
            # half of the anchor's hash will do, as segments that meet are compared by content
            yield s // 2, pack(((key[i] >> np.uint64(32)).astype(np.uint32), content[i], doc[d], th[d], by_digit(back), by_digit(first[i]), windows[i].astype(np.uint16), body))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, ids, hashes, held, texts = [], [], [], 0, 0
        empty = pa.array([None], pa.list_(pa.int64()))

        def out() -> Iterator[pa.RecordBatch]:
            for s, what in flush(blocks, ids, hashes):
                if s >= 0:
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([what], pa.binary()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), empty], names)
                elif len(what[0]):
                    b = _span_batch(*what)
                    ident = b.column(1).to_numpy() ^ b.column(0).fill_null(top).to_numpy()  # copies of a text are spread
                    to = (mix64(ident.view(np.uint64)) % np.uint64(n)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(to), pa.nulls(len(to), pa.binary()), *b.columns], names)

        for batch in batches:
            all_ids = batch.column(0).fill_null(top).to_numpy()
            all_th = batch.column(2).to_numpy()
            for a, b, data, offsets in text_blocks(batch.column(1)):
                code, doc, flat, sa, sb, origin = symbols(data, offsets)
                both = single_windows(find_segments(code, doc, size, gram), hot, code, size)
                here = 0
                for lone, seg in enumerate(both):
                    if len(seg.key):
                        end = seg.stop - 1 + size
                        content = range_hashes(code, seg.first, end) ^ mix64((seg.anchor - seg.first).astype(np.uint64))
                        ends = (sa[seg.first], sa[seg.anchor], sb[end - 1]) if not lone else (np.zeros(len(seg.key), np.int64),) * 3
                        blocks.append((seg.key, content, seg.doc + texts, seg.first - origin[seg.doc], seg.stop - seg.first, np.full(len(seg.key), lone), flat[: 0 if lone else None], *ends))
                        here += 1
                if here:
                    ids.append(all_ids[a:b])
                    hashes.append(all_th[a:b])
                    texts += b - a
                    held += len(data)
                if held >= RUN_BYTES:
                    yield from out()
                    blocks, ids, hashes, held, texts = [], [], [], 0, 0
        if blocks:
            yield from out()

    names = ["shard", "run", "doc_id", "th", "ab"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "th")
    sent = rows.mapInArrow(write, "shard int, run binary, doc_id long, th long, ab array<long>").repartition(parts, "shard")

    def read(table: pa.Table) -> pa.Table:
        settled = table.filter(pc.is_null(table["run"])).select(["doc_id", "th", "ab"])
        every = [unpack(x.as_py()) for x in table["run"] if x.is_valid]
        spans = []
        if lone := [r for r in every if r[7] is None]:
            occ = Occurrences.of(lone)
            twice = occ.take(first_and_later(occ.key, occ.content, occ.doc, occ.text_hash, occ.first)[1])
            spans.append((twice.doc, twice.text_hash, twice.first, twice.first + size))
        if whole := [r for r in every if r[7] is not None]:
            occ = Occurrences.of(whole).shared()
            if len(occ.key):
                seg, a, b = detail(occ, [r[7] for r in whole])
                spans.append((occ.doc[seg], occ.text_hash[seg], occ.first[seg] + a, occ.first[seg] + b - 1 + size))
        if not spans:
            return settled
        found = pa.Table.from_batches([_span_batch(*(np.concatenate(x) for x in zip(*spans, strict=True)))])
        return pa.concat_tables([settled.cast(found.schema), found])

    found = sent.groupBy("shard").applyInArrow(read, "doc_id long, th long, ab array<long>")
    return stage(found.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("ab")).alias("ab")), "spans")


def groups_of(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def identified(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The columns that :func:`repeated_spans` and the join back to texts need: the id as it was, ``doc_id`` (long), ``text``, ``th``.

    Ids that are no integers are numbered in their order, null last.
    """
    c = F.col
    rows = docs.select(c(id_col).alias("_id"), c(text_col).alias("text"), F.xxhash64(F.coalesce(c(text_col), F.lit(""))).alias("th"))
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return rows.withColumn("doc_id", c("_id").cast("long"))
    ranks = numbered(rows.filter("_id IS NOT NULL").select("_id").distinct(), ["_id"], "doc_id").select(c("_id").alias("_named"), c("doc_id").cast("long").alias("doc_id"))
    ranks = stage(ranks, "ranks")
    return rows.join(ranks, c("_id") == c("_named"), "left").drop("_named")


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``_id``, ``text`` and ``ab`` of all ``rows``, null where a text has no span. Only texts that may have one are shuffled."""
    c = F.col
    asked, maybe = maybe_in(rows, F.xxhash64("doc_id", "th"), spans.select(F.xxhash64("doc_id", "th").alias("h")), spans.count())
    sure = asked.filter(~maybe).select("_id", "text", F.lit(None).cast("array<long>").alias("ab"))
    r, s = asked.filter(maybe).select("_id", "text", "doc_id", "th").alias("r"), spans.alias("s")
    found = r.join(s, c("r.doc_id").eqNullSafe(c("s.doc_id")) & (c("r.th") == c("s.th")), "left").select("r._id", "r.text", "s.ab")
    return sure.unionByName(found)
