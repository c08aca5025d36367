"""Packing token sequences by patterns over the length histogram: the shortest pack that has room comes first."""

from __future__ import annotations

import json
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from annalist.plans.staging import discard, stage

# Fixed value: how byte-level tokenizers cut texts before they merge.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose ids a Python worker remembers (some 200 bytes each); when they are as many, it keeps them until they are as many again.
CACHED_CHUNKS = 1 << 18
#: Text that is encoded at once.
PORTION_BYTES = 1 << 23
#: A blank beside other white space.
_TOUCHING = r"[\s\v\x{85}\p{Z}] | [\s\v\x{85}\p{Z}]"
#: A single blank between two other signs.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it is visible, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _by_rank(model: dict) -> tiktoken.Encoding | None:
    """The same vocabulary for the faster library, which merges the pair with the smallest id first; none if merges are not in the order of ids."""
    signs, vocab = _byte_signs(), model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocab.get(a + b, -1) for a, b in merges]
    if model["type"] != "BPE" or model.get("ignore_merges") or ids != sorted(set(ids)) or any(c not in signs for x, _ in merges for c in x):
        return None
    if any(max(vocab[a], vocab[b]) >= i for (a, b), i in zip(merges, ids, strict=True)) or not all(c in vocab and vocab[c] < ids[0] for c in signs):
        return None
    ranks = {bytes([b]): vocab[c] for c, b in signs.items()} | {bytes(signs[c] for c in a + b): i for (a, b), i in zip(merges, ids, strict=True)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers, equal to encoding each whole text by the tokenizer file.

    Byte-level tokenizers cut texts into words before they merge, and always in front of a blank that is alone between two
    other signs; what lies between such places is encoded once and remembered for a while. Words are merged by ranks where the file's
    merges are in the order of their ids, else by the file's own library, which also takes texts with added tokens. A
    tokenizer of another kind gets whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        pre = made["pre_tokenizer"] or {}
        self.added = [x["content"] for x in made["added_tokens"]]
        apart = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in made["added_tokens"])
        self.in_chunks = bool(apart and not made["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        self.ranked = _by_rank(made["model"]) if self.in_chunks else None
        self.sizes = np.zeros(self.ranked.max_token_value + 1, np.int64) if self.ranked else None
        if self.ranked:
            for token in self.ranked.token_byte_values():
                self.sizes[self.ranked.encode_single_token(token)] = len(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _alone(self, text: str) -> bytes:
        if self.ranked and not any(x in text for x in self.added):
            return np.array(self.ranked.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, words: list[str]) -> list[bytes]:
        """The ids of words with a blank in front, by one call for those that can stand side by side."""
        odd = [x for x in self.added if any(x in w for w in words)]
        beside = [w and not w[0].isspace() and not w[-1].isspace() and not any(x in w for x in odd) for w in words] if self.ranked else [False] * len(words)
        row = [w for w, b in zip(words, beside, strict=True) if b]
        if not row:
            return [self._alone(f" {w}") for w in words]
        ids = self.ranked.encode_to_numpy(f" {' '.join(row)}").astype("<u4")
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) + 1 for w in row])) + 1
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        own = iter([raw[a:b] for a, b in pairwise(at)])
        return [next(own) if b else self._alone(f" {w}") for w, b in zip(words, beside, strict=True)]

    def _of_words(self, words: list[str]) -> list[bytes]:
        """The ids of words with a blank in front. Those asked for lately are remembered."""
        out = list(map(self.young.get, words))
        missing = [i for i, known in enumerate(out) if known is None]
        for a in range(0, len(missing), CACHED_CHUNKS):
            part = missing[a : a + CACHED_CHUNKS]
            if len(self.young) + len(part) > CACHED_CHUNKS:
                self.old, self.young = self.young, {}
            new = []
            for i in part:
                out[i] = self.old.get(words[i])
                if out[i] is None:
                    new.append(i)
            for i, ids in zip(new, self._new([words[i] for i in new]), strict=True):
                out[i] = ids
            self.young.update((words[i], out[i]) for i in part)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text``, without special ones."""
        if not self.in_chunks:
            return self._alone(text)
        first, *rest = _CUT.split(text)
        return (self._alone(first) if first else b"") + b"".join(self._of_words(rest))

    def encode_all(self, texts: pa.StringArray, last: bytes) -> pa.LargeBinaryArray:
        """The ids of each text (null: none) and then ``last``; words are looked up once for all texts."""
        texts = texts.fill_null("").cast(pa.large_string())
        plain = pc.invert(pc.match_substring_regex(texts, _TOUCHING)).to_numpy(zero_copy_only=False) if self.in_chunks else np.zeros(len(texts), bool)
        odd = np.flatnonzero(~plain)
        single = pa.array([self.encode(t) + last for t in texts.take(pa.array(odd)).to_pylist()], pa.large_binary())
        words = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        flat, starts = words.flatten(), words.offsets.to_numpy()
        starts = starts - starts[0] if len(starts) else starts
        coded = flat.dictionary_encode()
        firsts = flat.take(pa.array(starts[:-1])).to_pylist() if len(starts) > 1 else []
        values = pa.array([*self._of_words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), *(self._alone(x) if x else b"" for x in firsts), last], pa.large_binary())
        n, known = len(firsts), len(coded.dictionary)
        picks = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        picks[starts[:-1]] = known + np.arange(n)
        picks = np.insert(picks, starts[1:], known + n)  # the end of each text
        joined = values.take(pa.array(picks))
        ends = joined.buffers()[1]
        at = np.frombuffer(ends, np.int64)[joined.offset : joined.offset + len(joined) + 1][starts + np.arange(n + 1)] if n else np.zeros(1, np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(at)), joined.buffers()[2]])
        place = np.empty(len(texts), np.int64)
        place[np.flatnonzero(plain)], place[odd] = np.arange(n), n + np.arange(len(odd))
        return pa.concat_arrays([whole, single]).take(pa.array(place))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Documents of one length from a rank on, and which of their tokens: length, first rank, start, size.
Slot = tuple[int, int, int, int]


class Packs:
    """Equal packs: how many, and the slots of each; copy ``i`` takes the document of rank ``first + i`` for each slot."""

    __slots__ = ("count", "slots", "used")

    def __init__(self, count: int, slots: list[Slot], used: int):
        self.count, self.slots, self.used = count, slots, used

    def split(self, m: int) -> tuple[Packs, Packs | None]:
        """At most the first ``m`` copies, and the others."""
        if m >= self.count:
            return self, None
        later = [(n, first + m, start, size) for n, first, start, size in self.slots]
        return Packs(m, list(self.slots), self.used), Packs(self.count - m, later, self.used)


def shortest_pack_first(histogram: Mapping[int, int], capacity: int) -> list[Packs]:
    """Packs of documents, longest lengths first, each into the emptiest pack that has room, else into a new one.

    Documents of a length and packs of a pattern are handled by their numbers, so the work depends on the lengths that occur,
    of which there are at most ``capacity``, and not on the documents.
    """
    room: list[list[Packs]] = [[] for _ in range(capacity + 1)]  # by free tokens
    widest = lambda most, least: next((r for r in range(most, least - 1, -1) if room[r]), None)
    for length in sorted((n for n, k in histogram.items() if k), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = widest(capacity, length)
            if at is None:  # new packs, each filled before the next is opened
                each = capacity // length
                for copies, per in ((left // each, each), (1, left % each)):
                    if copies and per:
                        room[capacity - per * length].append(Packs(copies, [(length, rank + j * copies, 0, length) for j in range(per)], per * length))
                        rank += copies * per
                break
            packs, others = room[at].pop(max(range(len(room[at])), key=lambda i: room[at][i].count)).split(left)
            if others:
                room[at].append(others)
            below = widest(at, length) or length
            per = max(1, min((at - below) // length, left // packs.count))
            packs.slots = packs.slots + [(length, rank + j * packs.count, 0, length) for j in range(per)]
            packs.used += per * length
            room[at - per * length].append(packs)
            rank, left = rank + per * packs.count, left - per * packs.count
    return [p for ps in room for p in ps]


def _move(source: Packs, to: Packs, most: int) -> int:
    """Give up to ``most`` tokens of each source pack away: a whole slot if one fits, else the end of the longest."""
    fits = [i for i, s in enumerate(source.slots) if s[3] <= most]
    i = max(fits or range(len(source.slots)), key=lambda i: source.slots[i][3])
    length, first, start, size = source.slots[i]
    take = min(size, most)
    kept = [] if take == size else [(length, first, start, size - take)]
    source.slots = source.slots[:i] + kept + source.slots[i + 1 :]
    to.slots = [*to.slots, (length, first, start + size - take, take)]
    source.used, to.used = source.used - take, to.used + take
    return take


def fill_gaps(packs: list[Packs], capacity: int) -> list[Packs]:
    """Full packs, and what is left in packs of falling powers of two: the emptiest packs are dealt out to the fullest ones.

    Whole documents go first; a document is cut only where none fits.
    """
    done = [p for p in packs if p.used == capacity]
    room: list[list[Packs]] = [[] for _ in range(capacity + 1)]  # by used tokens
    for p in packs:
        if p.used < capacity:
            room[p.used].append(p)
    while True:
        high = next((u for u in range(capacity - 1, 0, -1) if room[u]), 0)
        if not high:
            return done
        to = room[high].pop()
        low = next((u for u in range(1, high + 1) if room[u]), 0)
        source = room[low].pop() if low else None
        if to.count > 1 and (source is None or to.count >= 2 * source.count):  # among themselves, else a small number would be dealt out to a large one again and again
            if source:
                room[low].append(source)
            to, source = to.split(to.count // 2)
        elif source is None:  # the last one
            while to.used:
                size = 1 << (to.used.bit_length() - 1)
                piece = Packs(1, [], 0)
                while piece.used < size:
                    _move(to, piece, size - piece.used)
                done.append(piece)
            return done
        m = min(to.count, source.count)
        (to, a), (source, b) = to.split(m), source.split(m)
        for other in (a, b):
            if other:
                room[other.used].append(other)
        while to.used < capacity and source.used:
            _move(source, to, capacity - to.used)
        for p in (to, source):
            if p.used == capacity:
                done.append(p)
            elif p.used:
                room[p.used].append(p)


def patterns_by_rank(packs: list[Packs]) -> list[tuple[int, int, int, list[tuple[int, int, int, int]]]]:
    """What each document of a length gets: ``length``, ranks ``first`` to ``last`` (exclusive), and its pieces, each with start,
    size, the sequence of the document of rank ``first`` (one more for each rank) and its place there."""
    rows, sequence = defaultdict(list), 0
    for p in packs:
        offset = 0
        for length, first, start, size in p.slots:
            rows[length].append((first, first + p.count, start, size, sequence, offset))
            offset += size
        sequence += p.count
    out = []
    for length, own in rows.items():
        starts, open_ = defaultdict(list), []
        for x in own:
            starts[x[0]].append(x)
        for a, b in pairwise(sorted({y for x in own for y in x[:2]})):
            open_ = [x for x in open_ if x[1] > a] + starts[a]
            if open_:
                out.append((length, a, b, sorted((start, size, seq + a - first, offset) for first, _, start, size, seq, offset in open_)))
    return out


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of some ``PORTION_BYTES`` of text, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + PORTION_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def tokenised(docs: DataFrame, path: str, end: int | None, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: ``id``, ``ids`` (little-endian 32-bit), ``n`` tokens, the ``part`` of the table it is written in, and in that part the
    number of earlier documents with the same rest (``at``) and of earlier full sequences (``full_at``)."""
    kind = docs.schema[id_col].dataType.simpleString()
    last = b"" if end is None else np.array([end], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, full = TaskContext.get().partitionId(), Counter(), 0
        for batch in batches:
            for rows in _portions(batch):
                ids = encoder(path).encode_all(rows.column(1), last)
                n = pc.divide(pc.binary_length(ids), 4).to_pylist()
                at, before = [], []
                for size in n:
                    at.append(seen[size % capacity])
                    before.append(full)
                    seen[size % capacity] += 1
                    full += size // capacity
                arrays = [rows.column(0), ids.cast(pa.binary()), pa.array(n, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(before, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "ids", "n", "part", "at", "full_at"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, f"id {kind}, ids binary, n long, part int, at long, full_at long")


def _slice(ids: Column, start: Column, size: Column) -> Column:
    return F.substr(ids, (start * 4 + 1).cast("int"), (size * 4).cast("int"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens without padding.

    Returns one row per piece: the id, ``start`` and ``length`` in the document's tokens, ``ids`` (the piece's token ids, little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` there. A document is its ids by the ``tokenizer`` file and then ``end``.
    Whole multiples of the capacity are sequences of their own; what remains of each document is packed over the histogram of
    lengths, longest first into the emptiest pack that has room, and packs that stay open are filled from the emptiest ones
    (:func:`fill_gaps`), so that all sequences are full but for at most one of each power of two below the capacity. Null and
    empty texts are ``end`` alone (without it they have no token and no row); repeated rows are packed one by one; an empty
    table gives an empty result; other columns are ignored.

    Scale: texts are read once and their ids written once. The driver gets the histogram, at most ``capacity`` numbers, and the
    patterns, whose number hangs on the lengths alone, are sent to all tasks. A document's rank among those of its length is its
    place in its part of the table plus the sizes of earlier parts, so no length, however common, is ranked in one task; ids
    are shuffled once, by part and length, unless the parts' sizes are small enough for Spark to send them.
    """
    spark, c = docs.sparkSession, F.col
    made = stage(tokenised(docs, tokenizer, end, capacity, id_col, text_col).withColumn("rest", (c("n") % capacity).cast("int")), "tokens")
    sizes = stage(made.groupBy("part", "rest").agg(F.count("*").alias("k"), F.sum(F.expr(f"n div {capacity}")).alias("full")), "sizes")
    histogram = {r["rest"]: r["k"] for r in sizes.filter("rest > 0").groupBy("rest").agg(F.sum("k").alias("k")).collect()}  # at most one row per length
    packs = fill_gaps(shortest_pack_first(histogram, capacity), capacity)
    rows = patterns_by_rank(packs)
    plan = spark.createDataFrame(rows, "length int, first long, last long, own array<struct<start:long,size:long,seq:long,off:long>>")
    before = lambda by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.withColumn("base", F.coalesce(F.sum("k").over(before(["rest"])), F.lit(0))).select("part", "rest", "base")
    full = sizes.groupBy("part").agg(F.sum("full").alias("full")).withColumn("full_base", F.coalesce(F.sum("full").over(before([])), F.lit(0)))  # a row per part
    bases = stage(ranks.join(full.select("part", "full_base"), "part"), "bases")
    discard(sizes)
    ranked = made.join(bases, ["part", "rest"]).withColumn("rank", c("base") + c("at"))
    planned = ranked.join(F.broadcast(plan), (c("rest") == c("length")) & (c("rank") >= c("first")) & (c("rank") < c("last")), "left")
    whole, n_full = sum(p.count for p in packs), F.expr(f"n div {capacity}")
    piece = lambda start, size, seq, off: F.struct(start.alias("start"), size.alias("length"), _slice(c("ids"), start, size).alias("ids"), seq.alias("sequence_id"), off.alias("offset"))
    every = F.when(n_full > 0, F.sequence(F.lit(0).cast("long"), n_full - 1)).otherwise(F.array().cast("array<long>"))
    head = F.transform(every, lambda i: piece(i * capacity, F.lit(capacity).cast("long"), F.lit(whole).cast("long") + c("full_base") + c("full_at") + i, F.lit(0).cast("long")))
    tail = F.transform(F.coalesce("own", F.array().cast("array<struct<start:long,size:long,seq:long,off:long>>")), lambda x: piece(n_full * capacity + x["start"], x["size"], x["seq"] + c("rank") - c("first"), x["off"]))
    pieces = planned.select(c("id").alias(id_col), c("n").alias("doc_tokens"), F.explode(F.concat(head, tail)).alias("p"))
    return pieces.select(id_col, "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")
