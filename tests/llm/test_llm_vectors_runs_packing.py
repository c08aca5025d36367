"""Centroid clusters, periodic runs and packing against brute force, with the awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from annalist.llm import packing, queries
from annalist.llm.centroids import LARGEST, centroid_clusters, nearest
from annalist.llm.packing import Encoder, fill_gaps, pack_documents, patterns_by_rank, shortest_pack_first
from annalist.llm.periodic import collapse, periodic_runs, repeated_length, repeated_stretches, runs_of

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def clusters_by_hand(rows, k, rounds, seed="2:"):
    """Cluster and squared distance of each row, in plain integers; rows: (id, vector)."""
    first = sorted((i is None, hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v) for i, v in rows)[:k]
    centroids = [v for *_, v in first]
    for step in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in rows]
        if step == rounds:
            return found, centroids
        for n in range(len(centroids)):
            own = [v for (_, v), (_, m) in zip(rows, found, strict=True) if m == n]
            centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else centroids[n]


def test_nearest_is_exact_with_ties_and_large_numbers():
    r = np.random.default_rng(3)
    for size in (4, 200, 1 << 20, LARGEST):
        x = r.integers(-size, size + 1, (300, 64))
        c = np.concatenate([x[:10], x[:10], x[5:15] + r.integers(-1, 2, (10, 64)), x[200:203] // 2])
        own, dist = nearest(x, c)
        for i, v in enumerate(x.tolist()):
            d = [sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for w in c.tolist()]
            assert (own[i], dist[i]) == (d.index(min(d)), min(d))
    assert [len(y) for y in nearest(np.empty((0, 64), np.int64), c)] == [0, 0]


def test_centroid_clusters(spark):
    r = random.Random(5)
    vec = lambda: [r.randint(-3, 3) / 256 + r.choice([0, 0.5]) for _ in range(4)]
    rows = [(i, vec()) for i in range(60)] + [(None, vec()), (7, [0.25] * 4), (7, [0.25] * 4)]
    bad = [(100, None), (101, []), (102, [0.1] * 3), (103, [0.1, None, 0.1, 0.1]), (104, [0.1, float("nan"), 0.1, 0.1]), (105, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, cluster string, n int").repartition(3)
    got = centroid_clusters(df, k=9, rounds=3, dims=4).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want, centroids = clusters_by_hand(whole, 9, 3)
    assert sorted((str(x["vec_id"]), x["cluster"], x["distance"], x["centroid"]) for x in got) == sorted((str(i), n, d, centroids[n]) for (i, _), (d, n) in zip(whole, want, strict=True))
    for x in got:
        assert x["inertia"] == sum(d for d, _ in want) and x["cluster_inertia"] == sum(d for d, n in want if n == x["cluster"])
    few = centroid_clusters(df.filter("vec_id < 4"), k=9, rounds=2, dims=4).collect()
    assert len(few) == 4 and all(x["distance"] == 0 for x in few)
    assert centroid_clusters(df.limit(0), dims=4).count() == centroid_clusters(df.filter("vec_id >= 100"), dims=4).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        centroid_clusters(spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>"), dims=4).collect()


def runs_by_hand(w, least=24, exponent=3):
    n, out, seen = len(w), [], set()
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(i + 1, j)
    return sorted(out)


def periodic_words(r, most):
    n, letters, w = r.randint(0, most), "abcd"[: r.randint(1, 4)], []
    while len(w) < n:
        if r.random() < 0.5:
            w += [r.choice(letters) for _ in range(r.randint(1, 12))]
        else:
            w += ([r.choice(letters) for _ in range(r.randint(1, 9))] * 30)[: r.randint(2, 70)]
    return w


def test_runs_of():
    r = random.Random(3)
    assert repeated_length(24, 3) == 16 and all(repeated_length(a, e) == min(max(a, e * q) - q for q in range(1, 200)) for a in range(2, 60) for e in (2, 3, 5))
    for _ in range(800):
        w, (least, exponent) = periodic_words(r, 150), r.choice([(24, 3), (6, 3), (6, 2), (10, 2), (5, 4)])
        assert runs_of(w, least, exponent) == runs_by_hand(w, least, exponent)
    assert runs_of([str(i) for i in range(500)]) == [] and repeated_stretches(np.arange(500), 16, 24) == []
    long = [str(r.random()) for _ in range(3000)] + [str(i % 300) for i in range(3000)]
    assert runs_of(long) == [(3000, 3000, 300)]


def test_periodic_runs(spark):
    r = random.Random(8)
    texts = [None, "", " \n", "ein wort", "na " * 5000, *(" ".join(periodic_words(r, 200)) for _ in range(40))]
    rows = [(i, t, 1, "y") for i, t in enumerate(texts)] + [(7, texts[7], 1, "y"), (None, "x " * 30, 1, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, id string")
    for x in periodic_runs(df).collect():
        w = (texts[x["doc_id"]] or "").split() if x["doc_id"] is not None else ["x"] * 30
        want = runs_by_hand(w)
        gone = {i for a, n, q in want for i in range(a + q, a + n)}
        assert [tuple(y) for y in x["runs"]] == want and x["collapsed"] == " ".join(v for i, v in enumerate(w) if i not in gone) == " ".join(collapse(w, want))
    assert periodic_runs(df).count() == len(rows) and periodic_runs(df.limit(0)).count() == 0


def test_op12_on_the_smallest_table(spark):
    d = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{d}/documents.parquet").collect()}
    planted = 0
    for x in queries.op12_periodic_runs(spark, d).collect():
        w = [y for y in (docs[x["doc_id"]] or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if y]
        h = zlib.crc32(str(x["doc_id"]).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w, planted = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))], planted + 1
        runs = runs_by_hand(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda y: (-y[1] / y[2], y[0], y[2]), default=(None,) * 3)
        assert (x["n_runs"], x["start"], x["length"], x["period"]) == (len(runs), *best) and x["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert x["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and x["collapsed_sha256"] == sha(" ".join(y for i, y in enumerate(w) if i not in gone))
    assert planted > 5


def test_encoder_equals_whole_texts(spark, monkeypatch):
    r, whole = random.Random(2), Tokenizer.from_file(VOCAB)
    signs = ["a", "B", "ß", "é", "中", " ", " ", " ", "  ", "\n", "\t", "'s", "'", "1", "23", ".", "—", " ", " ", "\x1c", "\x85", "😀", "<|endoftext|>", "word", "\x00", "\x0b", "\u3000", "\u2028", "²"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(3000)] + [None, "", " ", "a " * 3000]
    texts += [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    want = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
    end = np.array([1], "<u4").tobytes()
    own = Encoder(VOCAB)
    assert own.in_chunks and own.ranked and own.encode_all(pa.array(texts, pa.string()), end).to_pylist() == want
    assert [own.encode(t or "") + end for t in texts] == want
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 3)
    assert own.encode_all(pa.array(texts, pa.string()), end).to_pylist() == want
    own.ranked = None  # as for a file whose merges are not in the order of its ids
    own.young, own.old = {}, {}
    assert own.encode_all(pa.array(texts[:400], pa.string()), end).to_pylist() == want[:400]
    own.in_chunks = False
    assert own.encode_all(pa.array(texts[:400], pa.string()), end).to_pylist() == want[:400] and len(own.encode_all(pa.array([], pa.string()), end)) == 0


def test_encoder_of_another_kind_takes_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, whole = Encoder(path), Tokenizer.from_file(path)
    texts = ["Ein  Wort, zwei", "Ünd DREI\n vier", ""]
    assert not own.in_chunks and own.encode_all(pa.array(texts), b"").to_pylist() == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_packs_hold_every_document_once():
    r = random.Random(1)
    for _ in range(200):
        cap = r.choice([8, 16, 64])
        h = {r.randint(1, cap - 1): r.randint(0, 9) for _ in range(r.randint(0, 20))}
        open_packs = shortest_pack_first(h, cap)
        assert sum(p.count * p.used for p in open_packs) == sum(n * k for n, k in h.items()) and all(p.used <= cap and p.used == sum(s[3] for s in p.slots) for p in open_packs)
        at, covered = defaultdict(list), defaultdict(int)
        for length, first, last, own in patterns_by_rank(fill_gaps(open_packs, cap)):
            assert sum(x[1] for x in own) == length and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[0][0] == 0
            covered[length] += last - first
            for rank in range(first, last):
                for _, size, seq, off in own:
                    at[seq + rank - first].append((off, size))
        assert dict(covered) == {n: k for n, k in h.items() if k}
        for s in at.values():
            s.sort()
            used = s[-1][0] + s[-1][1]
            assert all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and s[0][0] == 0 and (used == cap or used & (used - 1) == 0)
        assert sum(1 for s in at.values() if s[-1][0] + s[-1][1] < cap) <= cap.bit_length()


def test_many_documents_are_few_steps():
    """Numbers of documents, not documents, are dealt with; without any gap to fill nothing is cut."""
    packs = fill_gaps(shortest_pack_first({1500: 10**9, 700: 10**8, 1: 10**10}, 2048), 2048)
    assert sum(p.count * p.used for p in packs) == 1500 * 10**9 + 700 * 10**8 + 10**10 and len(packs) < 2000
    assert all(len(own) == 1 for _, _, _, own in patterns_by_rank(fill_gaps(shortest_pack_first({1024: 10, 512: 4}, 2048), 2048)))


def test_pack_documents(spark):
    r = random.Random(9)
    texts = [None, "", "x", "ja " * 3000, "<|endoftext|> ok", *(" ".join(r.choice(["eins", "zwei", "three", "café"]) for _ in range(r.randint(1, 90))) for _ in range(70))]
    rows = [(i, t, 1, "z") for i, t in enumerate(texts)] + [(5, texts[5], 1, "z")] * 40 + [(None, "leer", 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, ids string").repartition(5)
    whole = Tokenizer.from_file(VOCAB)
    ids = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 1]
    got = pack_documents(df, VOCAB, capacity=64).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x)
        seqs[x["sequence_id"]].append((x["offset"], x["length"]))
    assert set(by) == {x[0] for x in rows}
    for i, pieces in by.items():
        want = ids(texts[i] if i is not None else "leer")
        times = sum(1 for x in rows if x[0] == i)
        seen = [0] * len(want)
        for x in pieces:
            part = np.frombuffer(x["ids"], "<u4").tolist()
            assert part == want[x["start"] : x["start"] + x["length"]] and x["doc_tokens"] == len(want)
            for j in range(x["start"], x["start"] + x["length"]):
                seen[j] += 1
        assert seen == [times] * len(want)
    for s in seqs.values():
        s.sort()
        used = s[-1][0] + s[-1][1]
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and (used == 64 or used & (used - 1) == 0)
    assert pack_documents(df.limit(0), VOCAB).count() == 0
    assert pack_documents(df.filter("doc_id < 2"), VOCAB, end=None).count() == 0


def test_op13_on_the_smallest_table(spark):
    d = "/root/testdata/sf0.001"
    whole = Tokenizer.from_file(VOCAB)
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got, total, filled = defaultdict(int), 0, defaultdict(int)
    for x in queries.op13_packing(spark, d).collect():
        own = [*whole.encode(docs[x["doc_id"]] or "", add_special_tokens=False).ids, 1]
        assert x["ids_crc32"] == zlib.crc32(np.array(own[x["start"] : x["start"] + x["length"]], "<u4").tobytes()) and x["doc_tokens"] == len(own)
        got[x["doc_id"]] += x["length"]
        filled[x["sequence_id"]] += x["length"]
        total += x["length"]
    assert got.keys() == docs.keys() and sum(1 for n in filled.values() if n < 2048) <= 11
