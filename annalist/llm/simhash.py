"""SimHash near-duplicates through an inverted index over positional bytes of the fingerprints."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.filters import join_groups
from annalist.llm.vectext import mix64
from annalist.operators.components import connected_components
from annalist.plans.staging import stage

#: Distinct fingerprints from which postings use four bytes instead of three, where that loses nothing.
WIDE_POSTINGS = 30_000_000
#: Posting lists up to this length are compared pair by pair in bulk; longer ones by growing components.
SMALL_LIST = 24
#: Posting sets for limits under which no shared byte is certain. Of 512-bit fingerprints at a similarity of 0.8, 0.82, 0.85 and
#: 0.9 some 92, 95, 98 and 100 % of pairs meet in one of 216 triples and are within the limit (by simulation of independent bits).
LOOSE_SETS = 216
#: Posting sets of the first round where there are more; what it joins need not be linked again in the second.
FIRST_SETS = 8
#: Posting sets that are exchanged at a time where every candidate pair is wanted.
SETS_AT_ONCE = 24
#: Classes of shingles whose parities are kept of a set; candidates are held against them before texts are fetched.
PARITY_BITS = 256


def fingerprint(data: bytes, shingle: int, words: int = 1, seed: int = 42) -> np.ndarray:
    """SimHash of a UTF-8 text as ``words`` 64-bit numbers, ASCII upper case folded.

    A bit is set if over half of the shingles' hashes have it. The first number's hashes are the shingles' XXH64; further
    numbers scramble these.
    """
    out = np.zeros(words, np.uint64)
    flat, a, b = _spans(data, shingle)
    if not a:
        return out
    h = xxhash.xxh64_intdigest
    ones = np.zeros((words, 64), np.int64)
    for i in range(0, len(a), 1 << 14):
        ones += _bit_counts(np.array([h(flat[x:y], seed) for x, y in zip(a[i : i + (1 << 14)], b[i : i + (1 << 14)], strict=True)], "<u8"), words)
    return np.packbits(2 * ones > len(a), axis=1, bitorder="little").view("<u8")[:, 0]


def _spans(data: bytes, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The text with single blanks, and where its shingles start and end; a short text is one shingle, an empty one has none."""
    tokens = data.lower().split()  # for bytes both know ASCII only
    flat = b" ".join(tokens)
    if len(tokens) <= shingle:
        return flat, [0] * bool(tokens), [len(flat)] * bool(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    return flat, [0, *ends[: len(tokens) - shingle].tolist()], (ends[shingle - 1 :] - 1).tolist()


def _bit_counts(hashes: np.ndarray, words: int) -> np.ndarray:
    """How many of the hashes have each bit, for each number of a fingerprint."""
    ones = np.zeros((words, 64), np.int64)
    for i in range(0, len(hashes), 1 << 14):
        hs = hashes[i : i + (1 << 14)]
        for j in range(words):
            hj = mix64(hs + np.uint64(j)) if j else hs
            ones[j] += np.unpackbits(hj.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def shingle_set(data: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """Distinct XXH64 hashes of a UTF-8 text's shingles in order, ASCII upper case folded."""
    flat, a, b = _spans(data, shingle)
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(flat[x:y], seed) for x, y in zip(a, b, strict=True)], "<u8"))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether each of ``PARITY_BITS`` classes of a shingle set has an odd number of members, as 64-bit numbers."""
    odd = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def similarity_bound(n: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """The largest Jaccard similarity of two sets with ``n`` members together and ``differ`` unequal parities.

    A class whose parities differ holds a shingle that only one set has, so the sets differ in ``differ`` shingles at least.
    """
    return (n - differ) / np.maximum(n + differ, 1)


def similarity_of(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """Columns ``doc_id`` and ``f0`` to ``f<words - 1>`` (as signed longs) for every row; null text has zeros."""
    names = [f"f{j}" for j in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.zeros((batch.num_rows, words), np.uint64)
            for i, t in enumerate(batch.column(1)):
                fps[i] = fingerprint((t.as_py() or "").encode(), shingle, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(fps[:, j]).view(np.int64)) for j in range(words)]], ["doc_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def posting_width(n: int, n_bytes: int, differ: int) -> int:
    """Positions in a posting of ``n`` fingerprints: four in large corpora, but only where the sets then still surely cover."""
    return 4 if n >= WIDE_POSTINGS and n_bytes - differ >= 4 else 3


def posting_sets(n_bytes: int, width: int, differ: int, seed: int = 3) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions under which fingerprints are posted.

    Fingerprints with at most ``differ`` differing bits share at least ``n_bytes - differ`` positional bytes. Where that is
    ``width`` or more, the sets are such that two of them surely meet in one: for four of eight bytes the 20 triples with two
    positions of one third and one of the next, or three of one third, which every four positions contain; else all sets.
    Where no number of shared bytes is sure (long fingerprints, wide limits) the sets are ``LOOSE_SETS`` seeded ones, spread
    evenly over the positions, and meeting is likely instead of certain.
    """
    least = n_bytes - differ
    if (n_bytes, width, least) == (8, 3, 4):
        third = [0, 0, 0, 1, 1, 1, 2, 2]
        keep = lambda s: len({third[i] for i in s}) == 1 or any(sorted(third[i] for i in s) == sorted([g, g, (g + 1) % 3]) for g in range(3))
        return [s for s in combinations(range(8), 3) if keep(s)]
    if least >= 1:
        return list(combinations(range(n_bytes), min(width, least)))
    rng, out = np.random.default_rng(seed), set()
    while len(out) < LOOSE_SETS:
        order = rng.permutation(n_bytes)
        out |= {tuple(sorted(order[i : i + width].tolist())) for i in range(0, n_bytes - width + 1, width)}
    return sorted(out)[:LOOSE_SETS]


def _close(x: np.ndarray, y: np.ndarray, differ: int) -> np.ndarray:
    """Count filter, then verification: pairs that share enough positional bytes and differ in few enough bits.

    The last axis of both runs over the numbers of a fingerprint.
    """
    d = np.ascontiguousarray(np.bitwise_xor(x, y))
    n_bytes = 8 * d.shape[-1]
    tally = (d.view(np.uint8) == 0).sum(-1)
    return (tally >= max(1, n_bytes - differ)) & (np.bitwise_count(d).sum(-1) <= differ)


Close = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _grow(labels: np.ndarray, fps: np.ndarray, close: Close) -> list[np.ndarray]:
    """Links that join a posting list's close fingerprints: each is compared with the unreached only.

    Fingerprints with one label count as joined. Columns of a link: the smallest label of the component, which all its other
    labels are linked to, and the two rows that were close.
    """
    out, left = [], np.argsort(labels, kind="stable")
    while len(left):
        low = labels[left[0]]
        own = labels[left] == low
        front, left = left[own].tolist(), left[~own]
        while front and len(left):
            x = front.pop()
            near = close(fps[left], fps[x][None])
            if near.any():
                new, first = np.unique(labels[left[near]], return_index=True)
                out.append(np.stack([np.full(len(new), low), np.full(len(new), x), left[near][first]]))
                near = np.isin(labels[left], new)
                front.extend(left[near].tolist())
                left = left[~near]
    return out


def _all_close(labels: np.ndarray, fps: np.ndarray, close: Close) -> list[np.ndarray]:
    """All pairs of rows of a posting list that are close and have different labels; the largest label is not searched itself."""
    kinds, n = np.unique(labels, return_counts=True)
    most = labels == kinds[np.argmax(n)]
    order = np.concatenate([np.nonzero(~most)[0], np.nonzero(most)[0]])
    out = []
    for i in range(len(order) - int(most.sum())):
        x, rest = order[i], order[i + 1 :]
        near = rest[close(fps[rest], fps[x][None]) & (labels[rest] != labels[x])]
        out.append(np.stack([np.full(len(near), x), near]))
    return out


def links(fps: DataFrame, differ: int, words: int = 1, sets: Sequence[tuple[int, ...]] | None = None, pairs: str = "", similarity: float = 0.0) -> DataFrame:
    """Links (``a``, ``b``, values of ``key``) that join all fingerprints (``key``, ``f0``…) within ``differ`` bits of each other.

    Fingerprints with one key count as joined already; at first each has its own.

    The index maps a set of byte positions with their values to the fingerprints that have them; single bytes would give
    lists of a 256th of the corpus, so a posting holds several positions, see :func:`posting_sets`. Inside a list the shared
    positional bytes of a pair are tallied, pairs under the minimum dropped, the rest verified. In long lists a pair inside
    an already joined component is skipped, so a crowd of near copies costs about its length; no link between components is
    lost.

    With ``pairs`` of ``some`` or ``all`` there is a further column ``node``, and the result has the close fingerprints' own
    nodes (``a``, ``b``) with their keys (``x``, ``y``), to be verified. ``some`` are found as above; of ``all`` none is left
    out, but for pairs with one key and, by :func:`similarity_bound` of further columns ``n`` and ``p0``…, pairs whose sets
    cannot be as similar as ``similarity``.
    """
    names = [f"f{j}" for j in range(words)]
    held = [*names, *(f"p{j}" for j in range(PARITY_BITS // 64)), "n"] if pairs else names

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        near = _close(x[..., :words], y[..., :words], differ)
        if not pairs or not near.any():
            return near
        odd = np.bitwise_count(np.bitwise_xor(x[..., words:-1], y[..., words:-1])).sum(-1)
        return near & (similarity_bound((x[..., -1] + y[..., -1]).astype(np.int64), odd.astype(np.int64)) >= similarity)

    sets = posting_sets(8 * words, posting_width(fps.count(), 8 * words, differ), differ) if sets is None else sets
    byte = lambda p: F.shiftrightunsigned(f"f{p // 8}", 8 * (p % 8)).bitwiseAND(F.lit(255))

    def post(i: int, s: tuple[int, ...]):
        k = F.lit(i).cast("long")
        for p in s:
            k = F.shiftleft(k, 8).bitwiseOR(byte(p))
        return k

    own = "node" if pairs else "key"
    row = F.struct("key", own, *held) if pairs else F.struct("key", *held)
    keyed = fps.select(row.alias("r"), F.explode(F.array(*[post(i, s) for i, s in enumerate(sets)])).alias("k"))
    lists = keyed.groupBy("k").agg(F.collect_list("r").alias("rows"), F.min("r.key").alias("lo"), F.max("r.key").alias("hi")).filter("lo < hi").select("rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            off = np.asarray(col.offsets).astype(np.int64)
            ids = np.asarray(col.values.field(0))
            nodes = np.asarray(col.values.field(own))
            flat = np.stack([np.asarray(col.values.field(n)) for n in held], axis=1).view(np.uint64)
            size, found = np.diff(off), []

            def add(i: np.ndarray, j: np.ndarray, low: np.ndarray | None = None) -> None:
                found.append(np.stack([nodes[i], nodes[j], ids[i], ids[j]] if pairs else [ids[i] if low is None else low, ids[j]]))

            for s in np.unique(size):
                at = off[:-1][size == s]
                if s <= SMALL_LIST:
                    step = max(1, (1 << 16) // int(s * len(held)))
                    for cut in range(0, len(at), step):
                        idx = at[cut : cut + step, None] + np.arange(s)
                        m = flat[idx]
                        for i in range(s - 1):
                            r, q = np.nonzero(close(m[:, i : i + 1], m[:, i + 1 :]))
                            add(idx[r, i], idx[r, i + 1 + q])
                else:
                    for a in at:
                        if pairs == "all":
                            for i, j in _all_close(ids[a : a + s], flat[a : a + s], close):
                                add(a + i, a + j)
                        else:
                            for low, i, j in _grow(ids[a : a + s], flat[a : a + s], close):
                                add(a + i, a + j, low)
            e = np.concatenate(found, axis=1) if found else np.zeros((len(out), 0), np.int64)
            if pairs:
                e = e[:, e[2] != e[3]]
                e = np.where(e[0] < e[1], e, e[[1, 0, 3, 2]])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in e], out)

    out = ["a", "b", "x", "y"] if pairs else ["a", "b"]
    return lists.mapInArrow(run, ", ".join(f"{n} long" for n in out)).filter("a <> b").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, differ: int = 4, words: int = 1) -> DataFrame:
    """Near-duplicate components: one row per input row with the id, ``fingerprint`` (hex), ``component_id``.

    Shingles are ``shingle`` words, repeats included; a fingerprint has 64 times ``words`` bits. Documents are linked when
    their fingerprints differ in at most ``differ`` bits; ``component_id`` is the smallest id that can be reached. Null and
    empty texts have fingerprint zero and are linked like others. A null id takes its component's id (null if no member has
    one); repeated rows stay rows; an empty table gives an empty result; other columns are ignored.

    With one word and ``differ`` of 4 every link is found. With longer fingerprints and wider limits a link is found with
    high probability, see :func:`near_limit`. Equal fingerprints meet in one class first, so copies never become pairs.
    Components are found over classes by joins and minimum aggregates.
    """
    c, names = F.col, [f"f{j}" for j in range(words)]
    rows = fingerprints(docs, id_col, text_col, shingle, words)
    rows = stage(rows.withColumn("key", c("f0") if words == 1 else F.xxhash64(*names)), "fingerprints")
    labelled = stage(rows.groupBy("key", *names).agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).withColumn("root", c("key")), "classes")
    sets = posting_sets(8 * words, posting_width(labelled.count(), 8 * words, differ), differ)
    for part in [sets] if len(sets) < 4 * FIRST_SETS else [sets[::len(sets) // FIRST_SETS], [x for i, x in enumerate(sets) if i % (len(sets) // FIRST_SETS)]]:
        comps = connected_components(links(labelled.select(c("root").alias("key"), *names), differ, words, part))
        joined = labelled.join(comps, labelled["root"] == comps["node"], "left")
        labelled = stage(joined.select("key", *names, "low", "n", F.coalesce("component", "root").alias("root")), "classes")
    lowest = labelled.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("_members"))
    lowest = stage(lowest.withColumnRenamed("root", "_root"), "lowest")
    named = join_groups(labelled, lowest, c("root") == c("_root"), c("_members"), labelled.count())
    named = stage(named.select(c("key").alias("_key"), *[c(x).alias(f"_{x}") for x in names], "n", "component_id"), "named")
    text = F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in names])
    same = c("key") == c("_key")
    for x in names if words > 1 else ():  # a key of several words is a hash
        same &= c(x) == c(f"_{x}")
    return join_groups(rows, named, same, c("n"), rows.count()).select(c("doc_id").alias(id_col), text.alias("fingerprint"), "component_id")


def text_digest(text: Column) -> Column:
    """What tells texts under one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``node`` (a hash of the shingle set), the set's fingerprint, parities and size ``n``."""
    names = [*(f"f{j}" for j in range(words)), *(f"p{j}" for j in range(PARITY_BITS // 64)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 1 + len(names)), np.uint64)
            for i, t in enumerate(batch.column(2)):
                hs = shingle_set((t.as_py() or "").encode(), shingle)
                out[i, 0] = xxhash.xxh64_intdigest(hs.tobytes(), 7)
                out[i, 1 : 1 + words] = np.packbits(2 * _bit_counts(hs, words) > len(hs), axis=1, bitorder="little").view("<u8")[:, 0]
                out[i, 1 + words : -1], out[i, -1] = parities(hs), len(hs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in out.T]], ["doc_id", "digest", "node", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, digest long, node long, " + ", ".join(f"{n} long" for n in names))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the candidate ``pairs`` whose shingle sets are as similar as asked, as links ``a``, ``b`` of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in known:
                if len(known) >= 256:
                    known.clear()
                known[node] = shingle_set((text.as_py() or "").encode(), shingle)
            return known[node]

        for batch in batches:
            a, b, x, y, s, t = batch.columns
            a, b = a.to_pylist(), b.to_pylist()
            keep = pa.array([similarity_of(of(a[i], s[i]), of(b[i], t[i])) >= similarity for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(keep), y.filter(keep)], ["a", "b"])

    first, second = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "s"), ("b", "t")))
    whole = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y", "s", "t")
    return whole.mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, similarity: float, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, words: int = 8) -> DataFrame:
    """Components of texts whose sets of ``shingle`` words have at least this Jaccard similarity: one row per input row with
    the id, ``component_id``, ``digest`` (:func:`text_digest`) and ``kept``, whether it is the component's one
    document that stays: that with the smallest id (null last), of several texts under it that with the smallest digest.

    Candidates are texts that meet in a posting and differ in at most :func:`near_limit` bits with three deviations, which
    a pair of the similarity hardly exceeds, and whose sets' sizes and parities do not rule the similarity out (which is
    certain, so it loses none); each candidate's two shingle sets are compared before it links. Fingerprints are
    those of the sets, without repeats. Texts with equal sets are one node. Three rounds over a few posting sets take only
    links that may join something, so that crowds of near copies become one component; the last takes every candidate pair
    that is not yet in one component, from all posting sets, a group of them at a time so that exchanged files can go.
    Null, repeated and other awkward rows are treated as by :func:`simhash_components`.
    """
    c, spark, bits = F.col, docs.sparkSession, 64 * words
    names = [*(f"f{j}" for j in range(words)), *(f"p{j}" for j in range(PARITY_BITS // 64)), "n"]
    rows = stage(_sketches(docs, id_col, text_col, shingle, words), "sketches")
    nodes = rows.groupBy("node", *names).agg(F.min("doc_id").alias("low"), F.min(F.struct(c("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("one"), F.count("*").alias("rows"))
    nodes = stage(nodes.withColumn("key", c("node")), "nodes")
    differ = near_limit(similarity, bits, 3)
    sets = posting_sets(8 * words, 3, differ)
    few, more = max(1, len(sets) // FIRST_SETS), max(1, len(sets) // SETS_AT_ONCE)
    texts = docs.select(c(id_col).alias("_id"), text_digest(c(text_col)).alias("_digest"), c(text_col).alias("text"))

    def joined(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
        need = pairs.select(c("a").alias("node")).union(pairs.select(c("b").alias("node"))).distinct()
        ones = nodes.join(need, "node", "left_semi").select("node", c("one.doc_id").alias("_d"), c("one.digest").alias("_x"))
        same = texts["_id"].eqNullSafe(ones["_d"]) & (texts["_digest"] == ones["_x"])
        held = stage(texts.join(ones, same).groupBy("node").agg(F.first("text").alias("text")), "candidates")
        comps = connected_components(_verified(pairs, held, shingle, similarity)).select(c("node").alias("_n"), "component")
        out = nodes.join(comps, nodes["key"] == comps["_n"], "left")
        return stage(out.select("node", *names, "low", "one", "rows", F.coalesce("component", "key").alias("key")), "nodes")

    for most, part in ((near_limit((1 + similarity) / 2, bits, 0), sets[::few]), (near_limit(similarity, bits, 0), sets[few // 2 :: few]), (differ, sets[more // 2 :: more])):
        nodes = joined(nodes, stage(links(nodes, most, words, part, "some", similarity), "pairs"))
        spark.sparkContext._jvm.System.gc()  # lets Spark delete the exchanged files of what has ended, and what the driver keeps of it
    pairs = None
    for i in range(0, len(sets), SETS_AT_ONCE):
        found = stage(links(nodes, differ, words, sets[i : i + SETS_AT_ONCE], "all", similarity), "pairs")
        pairs = found if pairs is None else pairs.unionByName(found)
        spark.sparkContext._jvm.System.gc()
    nodes = joined(nodes, stage(pairs.distinct(), "pairs"))
    lowest = nodes.groupBy("key").agg(F.min("low").alias("component_id"), F.min("one").alias("stays"), F.count("*").alias("_members"))
    lowest = stage(lowest.withColumnRenamed("key", "_key"), "lowest")
    named = join_groups(nodes.select("node", "key", "rows"), lowest, c("key") == c("_key"), c("_members"), nodes.count())
    named = stage(named.select(c("node").alias("_node"), "rows", "component_id", "stays"), "named")
    found = join_groups(rows.select("doc_id", "node", "digest"), named, c("node") == c("_node"), c("rows"), rows.count())
    kept = c("doc_id").eqNullSafe(c("stays.doc_id")) & (c("digest") == c("stays.digest"))
    return found.select(c("doc_id").alias(id_col), "component_id", "digest", kept.alias("kept"))


def near_limit(similarity: float, bits: int, slack: float = 1.25) -> int:
    """Differing bits to expect between fingerprints of texts with this Jaccard similarity, plus ``slack`` deviations.

    Sets with Jaccard similarity J have the cosine 2J / (1 + J) if about equally large, and a bit of their SimHashes differs
    with the share of the angle in half a turn.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))
