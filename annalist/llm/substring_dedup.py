"""Substring deduplication by matching statistics against suffix automata of reference shards."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.anchors import Occurrences, groups_of, identified, offsets_of, repeated_spans, with_spans
from annalist.llm.vectext import NOT_SPACE, Words, covered
from annalist.plans.staging import stage

#: Words of an anchor.
GRAM = 8
#: Reference text of one broadcast automaton (which has some hundred times as many bytes), and automata of one pass.
REFERENCE_BYTES, PASS_SHARDS = 1 << 18, 4


class SuffixAutomaton:
    """A suffix automaton over several word sequences, extended one sequence at a time."""

    def __init__(self, next: list[dict[bytes, int]] | None = None, link: list[int] | None = None, length: list[int] | None = None) -> None:  # noqa: A002
        self.next: list[dict[bytes, int]] = next or [{}]
        self.link, self.length = link or [-1], length or [0]

    def add(self, words: list[bytes]) -> None:
        """Insert a sequence."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            if w in nxt[last]:  # another sequence has led here before
                q = nxt[last][w]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, w, q)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def statistics(self, words: list[bytes]) -> list[int]:
        """Length of the longest match that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        v = n = 0
        out = []
        for w in words:
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            to = nxt[v].get(w)
            if to is None:
                n = 0
            else:
                v, n = to, n + 1
            out.append(n)
        return out


def word_symbols(data: np.ndarray, offsets: np.ndarray):
    """Words of a block as symbols; the bytes sent are the words, a blank after each."""
    w = Words(data, offsets, NOT_SPACE, lower=False)
    lens = w.end - w.start
    at = np.flatnonzero(w._inside)
    begin = np.concatenate([[0], np.cumsum(lens + 1)])
    flat = np.full(int(begin[-1]), 32, np.uint8)
    flat[np.arange(len(at)) + np.repeat(np.arange(len(lens)), lens)] = data[at]
    return w.hashes(), w.doc, flat, begin[:-1], begin[1:] - 1, w.first


def encode_words(flat: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, i: np.ndarray):
    """Segments' words, one after the other."""
    lens = (b - a)[i]
    off = offsets_of(lens)
    pick = np.arange(off[-1]) - np.repeat(off[:-1], lens) + np.repeat(a[i], lens)
    return i, (lens.astype(np.uint32), flat[pick].tobytes())


def matched(automaton: SuffixAutomaton, words: list[bytes], size: int) -> list[tuple[int, int]]:
    """Maximal ranges of first words of windows that the automaton's sequences hold."""
    out, a, last = [], -1, -9
    for j, n in enumerate(automaton.statistics(words)):
        if n >= size:
            if last != j - 1:
                if a >= 0:
                    out.append((a, last - size + 2))
                a = j - size + 1
            last = j
    return [*out, (a, last - size + 2)] if a >= 0 else out


def match_words(size: int):
    """Windows of segments with equal anchors that an earlier segment has, by an automaton per anchor."""

    def detail(occ: Occurrences, bodies: list):
        seg, first, stop = [], [], []
        bounds = groups_of(occ.key)
        bodies = [(offsets_of(lens), text) for lens, text in bodies]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            automaton = SuffixAutomaton()
            for k in range(lo, hi):
                off, text = bodies[occ.run[k]]
                i = occ.at[k]
                words = text[off[i] : off[i + 1]].split(b" ")
                fresh = True
                if k > lo:
                    for a, b in matched(automaton, words, size):
                        fresh &= b - a < occ.windows[k]
                        seg.append(k)
                        first.append(a)
                        stop.append(b)
                if fresh and k < hi - 1:
                    automaton.add(words)
        return np.array(seg, np.int64), np.array(first, np.int64), np.array(stop, np.int64)

    return detail


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Remove words that lie in ``window`` consecutive words which also start earlier in the corpus.

    Words are runs without ASCII white space, unchanged. Earlier means in a document with a smaller id (null last), or in
    the same one at an earlier word; windows are judged on the input. Ids that are no integers count in their order. Returns one row per input row: the id, ``n_words``,
    ``n_removed``, ``kept_sha256`` (of the kept words joined by one blank) and, with ``texts``, ``kept`` itself. Null and
    empty texts have no words. Different texts under one id are ordered by a hash; rows equal in id and text are one
    document and get the same result. An empty table gives an empty result; other columns are ignored.

    Suffix automata of fixed shards that every document is streamed past would cost shards times corpus. So documents and
    reference meet by anchor (see :mod:`annalist.llm.anchors`): a shard builds the automaton of the segments around each
    repeated anchor as it streams them in corpus order, and a segment's matching statistics tell which of its windows an
    earlier one has. Only copies inside one task's run, and windows at anchors with very many segments, are settled by hashes
    (of 128 and 96 bits). Work grows with the corpus; texts are shuffled as compressed segments once, and those with a span
    once more for the result.
    """
    rows = identified(docs, text_col, id_col)
    spans = repeated_spans(rows, window, GRAM, word_symbols, encode_words, match_words(window))
    return _without(with_spans(rows, spans), docs.schema[id_col].dataType.simpleString(), id_col, texts)


def substring_dedup_against(
    docs: DataFrame, reference: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text", texts: bool = False
) -> DataFrame:
    """Remove words that lie in ``window`` consecutive words which a reference text holds; results as :func:`substring_dedup`.

    Tasks build a suffix automaton for each shard of some ``REFERENCE_BYTES`` of the reference; ``PASS_SHARDS`` of them at a
    time are broadcast, and all documents stream past them for their matching statistics. So what is broadcast is bounded,
    and a reference of a few megabytes (licenses, boilerplate, a list of quotations) takes a few scans and no shuffle of
    documents. Its cost is passes times corpus, which is why a corpus is not held against itself this way. Null texts have no
    words; repeated rows stay rows; empty tables work.
    """
    spark, c = docs.sparkSession, F.col
    kind = docs.schema[id_col].dataType.simpleString()
    known = reference.select(c(reference_col).alias("t")).filter("t IS NOT NULL").distinct()
    shards = -(-(known.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // REFERENCE_BYTES)
    rows = docs.select(c(id_col).alias("_id"), c(text_col).alias("text"), F.array().cast("array<long>").alias("ab"))
    if not shards:
        return _without(rows, kind, id_col, texts)

    def build(table: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton()
        for t in table["t"]:
            automaton.add(t.as_py().encode().split())
        return pa.table({"shard": table["shard"][:1], "automaton": pa.array([pickle.dumps(vars(automaton))], pa.binary())})

    split = known.withColumn("shard", F.pmod(F.xxhash64("t"), F.lit(shards)))
    automata = stage(split.groupBy("shard").applyInArrow(build, "shard long, automaton binary"), "automata")

    def streamer(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = [SuffixAutomaton(**pickle.loads(x)) for x in held.value]
            for batch in batches:
                found = []
                for text, ab in zip(batch.column(1), batch.column(2), strict=True):
                    words = (text.as_py() or "").encode().split()
                    found.append(ab.as_py() + [x for a in every for i, j in matched(a, words, window) for x in (i, j + window - 1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["_id", "text", "ab"])

        return run

    for at in range(0, shards, PASS_SHARDS):
        held = spark.sparkContext.broadcast([bytes(r["automaton"]) for r in automata.filter(c("shard").between(at, at + PASS_SHARDS - 1)).collect()])
        rows = rows.mapInArrow(streamer(held), f"_id {kind}, text string, ab array<long>")
        if at + PASS_SHARDS < shards:
            rows = stage(rows, "streamed")
            held.unpersist()
    return _without(rows, kind, id_col, texts)


def _without(rows: DataFrame, kind: str, id_col: str, texts: bool) -> DataFrame:
    """The result for ``_id``, ``text`` and the ranges of words ``ab`` that go."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha, kept = [], [], [], []
            for text, ab in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if ab.is_valid:
                    v = np.asarray(ab.values)
                    mask = covered(v[::2], v[1::2], len(words))
                    words = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
                n_removed.append(n_words[-1] - len(words))
                left = b" ".join(words)
                sha.append(hashlib.sha256(left).hexdigest())
                if texts:
                    kept.append(left.decode())
            cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.string())] if texts else []), names)

    names = [id_col, "n_words", "n_removed", "kept_sha256"] + (["kept"] if texts else [])
    return rows.mapInArrow(finish, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else ""))
