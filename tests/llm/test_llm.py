"""Training-data operators against brute force, on a small fixture with the awkward cases and on the smallest tables."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from annalist.llm import langid, mixing, simhash, warc  # noqa: E402
from annalist.llm.anchors import gram_hashes, sliding_argmin  # noqa: E402
from annalist.llm.chat import perspectives  # noqa: E402
from annalist.llm.decontaminate import BenchmarkIndex, benchmark_overlap, items_digest  # noqa: E402
from annalist.llm.exact_dedup import DigestIndex, exact_dedup, first_of_copies  # noqa: E402
from annalist.llm.html_text import extract_main_text, main_text  # noqa: E402
from annalist.llm.substring_dedup import SuffixAutomaton, substring_dedup, substring_dedup_against  # noqa: E402
from annalist.llm.suffix_dedup import LoserTree, old_windows, suffix_dedup  # noqa: E402

rng = random.Random(4)
VOCAB = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
say = lambda n: " ".join(rng.choice(VOCAB) for _ in range(n))
PASSAGE, LONG = say(60), say(4000)
BENCH = [("a", say(30)), ("b", say(12)), ("c", "Kurz, GUT"), ("d", None), ("e", ""), ("f", say(9)), ("a2", PASSAGE)]


def texts():
    base = [say(rng.randint(1, 120)) for _ in range(40)]
    out = [None, "", " \n\t", "x", "...", LONG, LONG + " und", LONG, "a" * 5000, "ab " * 700]
    out += base + base[:6] + [t.upper() for t in base[:3]] + [t.replace(" ", "\n ") for t in base[3:6]]
    out += [t + " " + rng.choice(VOCAB) for t in base[:10]] + [say(5) + " " + PASSAGE + " " + say(5) for _ in range(12)]
    out += [say(3) + " " + BENCH[0][1] + " " + say(4), BENCH[1][1].upper(), say(2) + " kurz-gut! " + say(2), BENCH[5][1] + "."]
    return out


TEXTS = texts()
SOURCES = [None if i % 9 == 0 else f"s{min(4, i % 7)}" for i in range(len(TEXTS))]


@pytest.fixture(scope="module")
def docs(spark):
    """The fixture's documents with a column that clashes with names the operators use inside."""
    rows = [(i, t, "en", s, i % 5, "k", 1, "f") for i, (t, s) in enumerate(zip(TEXTS, SOURCES, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, key string, n long, digest string").repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows and repeated ids."""
    rows = [(None, "eins zwei drei"), (None, "eins zwei drei"), (7, PASSAGE), (7, PASSAGE), (7, "anders"), (8, None), (None, None)]
    return spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, source string")


@pytest.fixture(autouse=True)
def fewer_exchanges(monkeypatch):
    """Near-dedup's posting sets in two exchanges, for short tests."""
    monkeypatch.setattr(simhash, "SETS_AT_ONCE", 128)


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_mixing(spark, docs, odd):
    got = mixing.mix_sources(docs)
    by = rows_of(got)
    size, took = {}, {}
    for i, (t, s) in enumerate(zip(TEXTS, SOURCES, strict=True)):
        n = len(brute.WORD.findall(t or ""))
        assert by[i]["size"] == n and by[i]["taken"] <= 2 * n
        size[s] = size.get(s, 0) + n
        took[s] = took.get(s, 0) + by[i]["taken"]
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        left, w = total - sum(2 * size[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        goal = {s: 2.0 * size[s] if s in capped else left * weight[s] / w for s in order}
        over = {s for s in order if goal[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    for i, s in enumerate(SOURCES):
        assert by[i]["target"] == pytest.approx(goal[s]) and by[i]["source_size"] == size[s]
    assert all(abs(took[s] - goal[s]) <= 2 for s in order)
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(odd).count() == 7 and mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_ranks_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 8)
    d = spark.range(500).selectExpr("id AS doc_id", "'zwei worte' AS text", "CASE WHEN id < 400 THEN 'a' ELSE 'b' END AS source")
    got = mixing.mix_sources(d).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r["t"] - r["g"]) <= 2 for r in got)


def test_fit_lengths_is_near_the_best():
    r = np.random.default_rng(1)
    for _ in range(60):
        n = np.unique(r.integers(1, 60, 8))
        c = r.integers(1, 5, len(n))
        goal = int(r.integers(0, (n * c).sum() + 10))
        take = mixing.fit_lengths(n, c, goal)
        reach = {0}
        for x, k in zip(n, c, strict=True):
            reach = {s + x * j for s in reach for j in range(k + 1)}
        assert (take <= c).all() and abs(int((take * n).sum()) - goal) <= min(abs(s - goal) for s in reach) + int(n[0])


def test_exact_dedup(spark, docs, odd):
    norm = lambda t: "".join(ch for ch in (t or "") if ch not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    by = rows_of(exact_dedup(docs))
    assert len(by) == len(TEXTS)
    for text, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert (by[i]["keep_id"], by[i]["group_size"], by[i]["kept"], by[i]["text_sha256"]) == (keep, len(members), i == keep, brute.sha(text.encode()))
    got = exact_dedup(odd).collect()
    assert len(got) == 7 and sum(r["kept"] for r in got) == 4
    assert {r["keep_id"] for r in got if r["group_size"] == 2} == {None, 7, 8}
    assert exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_splits_a_digest_that_several_texts_have(spark, docs, monkeypatch):
    by, weak = rows_of(exact_dedup(docs)), rows_of(exact_dedup(docs, digest=lambda norm: F.substring(F.sha2(norm, 256), 1, 1)))
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in by.items()} == {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in weak.items()}
    monkeypatch.setattr("annalist.llm.filters.FILTER_WORDS", 1)  # lets every row pass
    assert {i: tuple(r) for i, r in by.items()} == {i: tuple(r) for i, r in rows_of(exact_dedup(docs)).items()}


def test_first_of_copies(spark, docs, odd):
    kept = {i for i, r in rows_of(exact_dedup(docs)).items() if r["kept"]}
    got = first_of_copies(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(kept)
    assert first_of_copies(odd).count() == 4 and first_of_copies(docs.limit(0)).count() == 0


def test_digest_index_lookup(spark):
    ident = lambda df: df.select(F.sha2("t", 256).alias("digest"), F.struct("id").alias("ident"))
    index = DigestIndex(spark)
    index.flush(ident(spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id int, t string")), 2)
    index.flush(ident(spark.createDataFrame([(0, "b"), (9, "c")], "id int, t string")))
    got = {r["digest"]: (r["ident"]["id"], r["n"]) for r in index.compact().collect()}
    assert got == {brute.sha(b"a"): (1, 2), brute.sha(b"b"): (0, 2), brute.sha(b"c"): (9, 1)}
    asked = spark.createDataFrame([(5, "b"), (6, "zz")], "id int, t string").select(F.sha2("t", 256).alias("digest"), "id")
    assert {r["id"]: r["known"] and r["known"]["id"] for r in index.lookup(asked).collect()} == {5: 0, 6: None}


def test_chat(spark):
    at = 1_700_000_000
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "Hi"), (1, 2, "bob", "Yo"), (1, 3, "ann", None), (2, 0, "system", "x"), (None, 0, None, "y"), (3, 1, "a", "z"), (3, 1, "a", "z"), (3, None, "b", "w")]
    rows += [(4, at, "system", "S"), (4, at + 5000, "a", "q"), (4, at + 9, "b", "p<|im_end|>"), (4, None, "c\nd", "last")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumns({"part": F.lit("x"), "t": F.lit(1), "speaker": F.lit("y")})
    got = {(r["conv_id"], r["part"], r["speaker"]): r for r in perspectives(df).collect()}
    r = got[1, 0, "ann"]
    assert r["text"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\nYo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [r["text"][m["start"] : m["end"]] for m in r["mask"]] == ["Hi<|im_end|>", "<|im_end|>"]
    assert (2, 0, "system") not in got and got[None, 0, "unknown"]["n_turns"] == 1
    assert got[3, 0, "b"]["text"].endswith("w<|im_end|>\n") and got[3, 0, "a"]["n_turns"] == 3
    assert {k for k in got if k[0] == 4} == {(4, 0, "a"), (4, 0, "b"), (4, 0, "c d")} and all(got[4, 0, x]["n_turns"] == 4 for x in "ab")
    assert got[4, 0, "b"]["text"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\np< |im_end|><|im_end|>\n<|im_start|>user name=a\nq<|im_end|>\n<|im_start|>user name=c d\nlast<|im_end|>\n"
    assert perspectives(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0


def test_chat_continues_long_dialogues(spark):
    turns = [(c, 7 * i if i % 5 else 7, "ab"[i % 2], f"t{i}") for c, n in ((1, 10), (None, 7), (2, 3)) for i in range(n)]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").repartition(3)
    got = {(r["conv_id"], r["part"], r["speaker"]): r["text"] for r in perspectives(df, part_turns=4).collect()}
    whole = {(r["conv_id"], r["speaker"]): r["text"] for r in perspectives(df).collect()}
    assert {k[:2] for k in got} == {(1, 0), (1, 1), (1, 2), (None, 0), (None, 1), (2, 0)}
    for (conv, who), text in whole.items():
        assert "".join(got[conv, p, who] for p in range(3) if (conv, p, who) in got) == text


def test_chat_is_whole_and_cut_parts_repeat_the_scene(spark):
    df = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.lit("é" * 20).alias("text"))
    whole = {r["speaker"]: r for r in perspectives(df).collect()}
    assert set(whole) == {"a", "b"} and all(r["part"] == 0 and r["n_turns"] == 5000 for r in whole.values())
    parts = {(r["part"], r["speaker"]): r["text"] for r in perspectives(df, part_turns=2000).collect()}
    assert len(parts) == 6 and all(t.startswith("<|im_start|>system\n") and t.count("<|im_start|>system\n") == 1 for t in parts.values())
    assert sum(t.count("<|im_end|>") for (p, s), t in parts.items() if s == "a") == 5002


def test_simhash(spark, docs, odd):
    by = rows_of(simhash.simhash_components(docs))
    fps = {i: brute.fingerprint(t, 4) for i, t in enumerate(TEXTS)}
    assert {i: int(r["fingerprint"], 16) for i, r in by.items()} == fps
    want = brute.components(list(fps.items()), lambda x, y: (x ^ y).bit_count() <= 4)
    assert {i: r["component_id"] for i, r in by.items()} == want
    got = simhash.simhash_components(odd).collect()
    assert len(got) == 7 and {r["component_id"] for r in got} == {None, 7, 8}
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_posting_sets_cover():
    from itertools import combinations

    sets = simhash.posting_sets(8, 3, 4)
    assert len(sets) == 20 and all(any(set(s) <= set(q) for s in sets) for q in combinations(range(8), 4))
    assert sorted(simhash.posting_sets(8, 4, 4)) == sorted(combinations(range(8), 4))  # the wide postings of large corpora


@pytest.mark.parametrize("small", [24, 1])
def test_simhash_links_join_all_close_ones(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_LIST", small)
    r = np.random.default_rng(2)
    centres = r.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            fps.add(int(c) ^ sum(1 << int(b) for b in set(r.integers(0, 64, 5))))
    want = brute.components([(x, x) for x in sorted(fps)], lambda x, y: (x ^ y).bit_count() <= 4)
    signed = [(int(np.uint64(x).view(np.int64)),) * 2 for x in fps]
    from annalist.operators.components import connected_components

    comps = {r["node"]: r["component"] for r in connected_components(simhash.links(spark.createDataFrame(signed, "key long, f0 long"), 4)).collect()}
    classes = {}
    for x, root in want.items():
        s = int(np.uint64(x).view(np.int64))
        classes.setdefault(root, set()).add(comps.get(s, s))
    assert all(len(v) == 1 for v in classes.values()) and len(set.union(*classes.values())) == len(classes)


def test_long_fingerprints_find_near_copies(spark):
    long = [say(rng.randint(150, 400)).split() for _ in range(40)]
    near = []
    for w in long:
        v = list(w)
        v[len(v) // 2] = "ersetzt"
        near.append(v)
    rows = [(i, " ".join(w)) for i, w in enumerate(long + near)]
    comps = rows_of(simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, words=4, differ=simhash.near_limit(0.8, 256)))
    assert all(comps[i]["component_id"] == comps[i + 40]["component_id"] == i for i in range(40))


def test_width_of_postings_loses_nothing(spark, monkeypatch):
    assert [simhash.posting_width(n, 8, 4) for n in (1, 1 << 40)] == [3, 4] and simhash.posting_width(1 << 40, 32, 45) == 3
    monkeypatch.setattr(simhash, "WIDE_POSTINGS", 1)
    seen, real = [], simhash.posting_sets
    monkeypatch.setattr(simhash, "posting_sets", lambda *a: seen.append(a) or real(*a))
    simhash.simhash_components(spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string"), words=4, differ=45)
    assert seen == [(32, 3, 45)]


def test_loose_sets_find_most_pairs():
    r = np.random.default_rng(5)
    limit = simhash.near_limit(0.8, 512, 3)
    sets = simhash.posting_sets(64, 3, limit)
    for similarity, least in ((0.8, 0.9), (0.85, 0.97)):
        p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
        differ = r.random((4000, 64, 8)) < p
        met = np.any([(~differ.any(2))[:, list(s)].all(1) for s in sets], axis=0)
        assert np.mean(met & (differ.sum((1, 2)) <= limit)) >= least


def test_near_components_compare_the_shingles(spark):
    def change(w, n):
        v = list(w)
        for i in range(n):
            v[10 + i * (len(v) - 20) // n] = f"neu{i}"
        return v

    base = [[f"w{k}x{rng.randint(0, 10**6)}" for _ in range(300)] for k in range(12)]
    rows = [(100 * k + n, " ".join(change(w, n))) for k, w in enumerate(base) for n in (0, 2, 4, 8, 13)]
    rows += [(9000, "an der Ecke hier " * 200 + " ".join(base[0][:60])), (9001, "an der Ecke hier " * 200 + " ".join(base[1][:60])), (9002, None), (9003, ""), (None, "allein")]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in rows}
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 1
    want = brute.components([(i, s) for i, s in sets.items() if i is not None], lambda x, y: jaccard(x, y) >= 0.8)
    by = rows_of(simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 0.8))
    assert by.pop(None)["component_id"] is None and len(set(want.values())) > 30
    assert all(want[r["component_id"]] == want[i] for i, r in by.items())  # nothing is joined that should not be
    assert np.mean([r["component_id"] == want[i] for i, r in by.items()]) >= 0.95
    import corpus_pipeline

    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'de' AS lang", "'s' AS source", "length(text) AS n_chars")
    assert set(want.values()) <= {r["doc_id"] for r in corpus_pipeline.near_copies(spark, d, "").collect()}


def test_near_copies_just_over_the_limit_are_found(spark):
    """Documents with words exchanged until the Jaccard similarity is just over 0.8: nine in ten at least meet their original."""
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    jaccard = lambda x, y: simhash.similarity_of(*(simhash.shingle_set(" ".join(w).encode(), 5) for w in (x, y)))
    rows, seen = [], set()
    for t in docs:
        w = (t or "").split()
        if 100 <= len(w) <= 2000 and tuple(w[:12]) not in seen and len(rows) < 400:
            seen.add(tuple(w[:12]))
            v, n = list(w), 0
            for i in rng.sample(range(len(w)), len(w)):
                u = list(v)
                u[i] = f"neu{i}"
                if jaccard(w, u) < 0.8:
                    break
                v, n = u, n + 1
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 0.8).collect()}
    assert len(rows) == 400 and np.mean([comp[i] == comp[i + 1] for i in range(0, 400, 2)]) >= 0.9


def test_parities_rule_out_nothing_similar():
    r = np.random.default_rng(8)
    for _ in range(300):
        common = r.integers(0, 1 << 63, int(r.integers(0, 300)), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([common, r.integers(0, 1 << 63, int(r.integers(0, 60)), dtype=np.uint64)])) for _ in range(2))
        odd = int(np.bitwise_count(simhash.parities(x) ^ simhash.parities(y)).sum())
        assert simhash.similarity_bound(np.array(len(x) + len(y)), np.array(odd)) >= min(1, simhash.similarity_of(x, y)) - 1e-12 or len(x) + len(y) == 0


def test_substring_dedup(spark, docs, odd):
    by = rows_of(substring_dedup(docs))
    seq = [(i, [w.encode() for w in brute.WORD.findall(t or "")]) for i, t in enumerate(TEXTS)]
    cov = brute.repeats(seq, 20)
    assert sum(map(len, cov.values())) > 8000
    for i, w in seq:
        kept = b" ".join(x for k, x in enumerate(w) if k not in cov[i])
        assert (by[i]["n_words"], by[i]["n_removed"], by[i]["kept_sha256"]) == (len(w), len(cov[i]), brute.sha(kept))
    got = substring_dedup(odd, texts=True).collect()
    assert len(got) == 7 and [r["n_removed"] for r in got if r["n_words"] == 60] == [0, 0]
    assert substring_dedup(docs.limit(0)).count() == 0


def test_suffix_dedup(spark, docs, odd):
    by = rows_of(suffix_dedup(docs))
    seq = [(i, (t or "").encode()) for i, t in enumerate(TEXTS)]
    cov = brute.repeats(seq, 100)
    for i, b in seq:
        c = sorted(cov[i])
        spans = sum(k == 0 or c[k] != c[k - 1] + 1 for k in range(len(c)))
        kept = bytes(x for k, x in enumerate(b) if k not in cov[i])
        assert (by[i]["n_bytes"], by[i]["n_removed"], by[i]["n_spans"], by[i]["kept_sha256"]) == (len(b), len(c), spans, brute.sha(kept))
    assert suffix_dedup(odd, texts=True).count() == 7 and suffix_dedup(docs.limit(0)).count() == 0


def test_substring_dedup_against_a_reference(spark, docs, monkeypatch):
    monkeypatch.setattr("annalist.llm.substring_dedup.REFERENCE_BYTES", 300)
    monkeypatch.setattr("annalist.llm.substring_dedup.PASS_SHARDS", 2)
    held = [PASSAGE, LONG, None, "", say(30), *[t for _, t in BENCH if t]]
    by = rows_of(substring_dedup_against(docs, spark.createDataFrame([(t,) for t in held], "text string"), texts=True))
    known = {tuple(w[i : i + 20]) for t in held for w in [brute.WORD.findall(t or "")] for i in range(len(w) - 19)}
    for i, t in enumerate(TEXTS):
        w = brute.WORD.findall(t or "")
        gone = {p for a in range(len(w) - 19) if tuple(w[a : a + 20]) in known for p in range(a, a + 20)}
        assert (by[i]["n_words"], by[i]["n_removed"], by[i]["kept"]) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    assert sum(r["n_removed"] for r in by.values()) > 8000
    none = rows_of(substring_dedup_against(docs, spark.createDataFrame([], "text string")))
    assert len(none) == len(TEXTS) and not any(r["n_removed"] for r in none.values())


def test_window_dedup_with_hot_anchors_and_other_ids(spark, docs, monkeypatch):
    names = {i: f"k{i:05d}" for i in range(len(TEXTS))}
    words, strings = rows_of(substring_dedup(docs)), rows_of(suffix_dedup(docs))
    monkeypatch.setattr("annalist.llm.anchors.HOT_BYTES", 100)
    monkeypatch.setattr("annalist.llm.anchors.LEAST_SEEN", 4)
    d = docs.withColumn("doc_id", F.format_string("k%05d", "doc_id"))
    for f, want in ((substring_dedup, words), (suffix_dedup, strings)):
        got = rows_of(f(d))
        assert {i: tuple(got[names[i]])[1:] for i in want} == {i: tuple(r)[1:] for i, r in want.items()}


def test_old_windows():
    for _ in range(300):
        size, k = 12, rng.randint(2, 5)
        fronts, tails, windows = [], [], []
        for _ in range(k):
            front = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8)))
            fronts.append(front)
            windows.append(rng.randint(1, len(front) + 1))
            tails.append(b"ANCH" + bytes(rng.choice(b"ab") for _ in range(size - len(front) + windows[-1] - 1 - 4)))
        order = sorted(range(k), key=lambda i: tails[i])
        shared = [0, *(len(os.path.commonprefix([tails[a], tails[b]])) for a, b in zip(order, order[1:]))]
        seen, want = set(), set()
        for i in range(k):
            for j in range(windows[i]):
                w = (len(fronts[i]) - j, (fronts[i] + tails[i])[j : j + size])
                want |= {(i, j)} if w in seen else set()
                seen.add(w)
        got = [(i, j) for i, a, b in old_windows(size, fronts, windows, [order.index(i) for i in range(k)], shared) for j in range(a, b)]
        assert sorted(got) == sorted(want), (fronts, tails, windows)


def test_automaton_statistics():
    a = SuffixAutomaton()
    seqs = [[rng.choice(b"abc").to_bytes() for _ in range(30)] for _ in range(5)]
    for s in seqs[:4]:
        a.add(s)
    have = {tuple(s[i:j]) for s in seqs[:4] for i in range(30) for j in range(i + 1, 31)}
    want = [max((n for n in range(i + 2) if n == 0 or tuple(seqs[4][i + 1 - n : i + 1]) in have)) for i in range(30)]
    assert a.statistics(seqs[4]) == want


def test_loser_tree():
    runs = [sorted(bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 20))) for _ in range(7)]
    lcp = lambda x, y: len(os.path.commonprefix([x, y]))
    tree = LoserTree([(r, [0, *map(lcp, r, r[1:])]) for r in runs])
    out = [(runs[r][i], n) for r, i, n in tree.merge()]
    want = sorted(sum(runs, []))
    assert [x for x, _ in out] == want and [n for _, n in out][1:] == list(map(lcp, want, want[1:]))


def test_sliding_argmin():
    x = gram_hashes(np.random.default_rng(0).integers(0, 5, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2)
    hi = x >> np.uint64(24)
    assert sliding_argmin(x, 9).tolist() == [i + int(np.argmin(hi[i : i + 9])) for i in range(len(x) - 8)]


def test_decontamination(spark, docs, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    run = lambda: rows_of(benchmark_overlap(docs, bench, keep=("text", "key")).withColumn("sha", items_digest()))
    by = run()
    assert sum(r["n_hit"] > 0 for r in by.values()) >= 15
    for i, t in enumerate(TEXTS):
        r = by[i]
        assert (r["n_words"], r["n_hit"], len(r["items"]), r["sha"]) == brute.overlap(t, BENCH) and r["text"] == t
        assert sum(s["b"] - s["a"] for s in r["spans"]) == r["n_hit"]
    from annalist.llm import decontaminate

    monkeypatch.setattr(decontaminate, "PASS_BYTES", 300)
    again = run()
    assert {i: (r["n_hit"], r["items"], r["text"]) for i, r in again.items()} == {i: (r["n_hit"], r["items"], r["text"]) for i, r in by.items()}
    assert benchmark_overlap(docs, bench.limit(0)).filter("n_hit > 0").count() == 0 and benchmark_overlap(docs.limit(0), bench).count() == 0
    assert len(BenchmarkIndex([], 10, 5).key) == 0
    unnamed = rows_of(benchmark_overlap(docs, spark.createDataFrame([(None, t) for _, t in BENCH], "item_id string, text string")))
    assert all(r["n_hit"] == by[i]["n_hit"] and r["items"] == [] for i, r in unnamed.items())


def test_benchmark_windows_are_compared(spark, docs, monkeypatch):
    from annalist.llm import decontaminate

    bench = spark.createDataFrame(BENCH, "item_id string, text string")
    want = {i: (r["n_hit"], r["items"]) for i, r in rows_of(benchmark_overlap(docs, bench)).items()}
    monkeypatch.setattr(decontaminate.Words, "hashes", lambda self: np.ones(len(self.start), np.uint64))  # all hashes collide
    index = BenchmarkIndex([x for x in BENCH if x[1]], 10, 5)
    for i, t in list(enumerate(TEXTS))[:30] + list(enumerate(TEXTS))[-16:]:
        data = np.frombuffer((t or "").encode(), np.uint8)
        if len(data) < 3000:
            w = decontaminate.Words(data, np.array([0, len(data)]), decontaminate.ALNUM, lower=True)
            s, n, item = index.hits(w)
            assert (len({p for a, k in zip(s, n) for p in range(a, a + k)}), sorted({index.ids[x] for x in item})) == want[i]


def test_language_id(spark):
    path = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.train(d.filter(~langid.held_out(F.col("doc_id"))))
    got = langid.identify(d, model).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "12 34 …", None), (4, "a", None), (None, "the of and", "en")], "doc_id int, text string, score string")
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()}
    assert pred[1] == pred[2] == pred[3] == "und" and pred[4] in model.langs and pred[None] == "en"
    nothing = langid.train(d.filter("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.identify(d.limit(3), nothing).collect()} == {"und"}
    only = langid.train(d.filter("lang = 'de'"))
    assert {r["lang_pred"] for r in langid.identify(d.limit(3), only).collect()} == {"de"}
    assert langid.identify(d.limit(0), model).count() == 0


def test_language_decoding_against_plain_python(spark):
    """Counts, classifiers, trust and decoding again, without numpy arrays of features."""
    import math

    d = spark.createDataFrame([(i, " ".join(rng.choice(w) for _ in range(6)), lang) for i in range(60) for lang, w in (("x", ["abc", "bca"]), ("y", ["cab", "ddé"]), ("z", ["aab", "Zz9"]))][:170], "doc_id int, text string, lang string")
    model, rows = langid.train(d), d.select("*", (F.pmod(F.xxhash64("text"), F.lit(langid.JUDGED)) == 0).alias("judged")).collect()

    def grams(t):
        b = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in t.encode())
        b = b" " + b + b" "
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % (1 << 32)) >> 17 for i in range(len(b) - 2) if b[i : i + 2] != b"  "]

    def fit(rows):
        n = {k: {} for k in "xyz"}
        for r in rows:
            for g in grams(r["text"]):
                n[r["lang"]][g] = n[r["lang"]].get(g, 0) + 1
        size = {k: sum(v.values()) + 0.5 * langid.FEATURES for k, v in n.items()}
        share = lambda k, g: (n[k].get(g, 0) + 0.5) / size[k]
        return lambda g, code: math.log(np.mean([share(k, g) for k, c in zip("xyz", code) if c > 0])) - math.log(np.mean([share(k, g) for k, c in zip("xyz", code) if c < 0]))

    codes = langid.codewords(3).T.tolist()
    final, part = fit(rows), fit([r for r in rows if not r["judged"]])
    vote = lambda w, t, code: langid.SHARPNESS * math.tanh(sum(w(g, code) for g in grams(t)) / langid.SHARPNESS)
    trust = {}
    for k, lang in enumerate("xyz"):
        own = [r for r in rows if r["judged"] and r["lang"] == lang]
        raw = [(sum(np.sign(vote(part, r["text"], c)) == c[k] for r in own) + 1) / (len(own) + 2) for c in codes]
        trust[k] = [x / sum(raw) * len(codes) for x in raw]
    for r in langid.identify(d, model).collect():
        loss = [sum(t * math.log1p(math.exp(-vote(final, r["text"], c) * c[k])) for t, c in zip(trust[k], codes)) for k in range(3)]
        p = [math.exp(min(loss) - x) for x in loss]
        assert r["lang_pred"] == "xyz"[int(np.argmin(loss))] and r["score"] == pytest.approx(1 / sum(p), rel=1e-4)
        assert r["ambiguous"] == (sorted(loss)[1] - min(loss) < langid.MARGIN)


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    d = spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(4)], "text string, lang string")
    with pytest.raises(ValueError, match="more than 3"):
        langid.train(d)
    assert langid.train(d.filter("lang <> 'l0'")).langs == ["l1", "l2", "l3"]


def test_codewords():
    for n in (2, 3, 4, 6, 9, 20):
        m = langid.codewords(n)
        assert m.shape[0] == n and len({tuple(r) for r in m.tolist()}) == n and (np.abs(m.sum(0)) < n).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Start</a></li></ul></nav><!-- x -->
<div class="ad">Buy the best of the things that are in this shop now</div><div id="cookie-notice">We use cookies to make the site and all of its parts work for you today, ok</div>
<article><h1>Title &amp; more</h1><p>First  paragraph of the text,\n and it is <b>long</b> enough to be judged by itself as a block of the article.</p><p>Short.</p><section class="comments"><p>Reader says the article is the best of all that is here in the web.</p></section>
<form><p>Your name</p></form><p>Last one is &quot;here&quot; and it has the words of the language in it so that it is text.</p></article><aside>Related</aside><footer>&copy; x</footer></body></html>"""


def test_warc_same_page_under_two_urls(spark, tmp_path):
    """Long pages that are equal but for their url are records of their own; rows equal in all are repeated."""
    long = "é" * 30_000
    pages = spark.createDataFrame([(1, "u", long), (1, "v", long), (1, "v", long), (2, "w", long), (None, "x", long)], "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, str(tmp_path / "w"))
    got = sorted((str(r["page_id"]), r["url"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert got == [("1", "u", "response", None), ("1", "v", "response", None), ("1", "v", "response", None), ("2", "w", "revisit", 1), ("None", "x", "revisit", 1)]


def test_html(spark):
    want = 'Title & more\n\nFirst paragraph of the text, and it is long enough to be judged by itself as a block of the article.\n\nShort.\n\nLast one is "here" and it has the words of the language in it so that it is text.'
    assert main_text(PAGE) == want and main_text(None) == main_text("") == ""
    assert main_text("<nav><a href=x>menu<article><p>the text of it all") == "the text of it all"
    assert main_text("<p>" + "x" * 100_000 + "</p>").startswith("x") is False
    assert main_text("plain the of and words that go on for long enough to be text of the page itself, and so on") != ""
    assert main_text("<div " + '"' * 5001 + "a" * 20000) is not None
    got = extract_main_text(spark.createDataFrame([(1, PAGE), (None, None), (2, "")], "page_id int, html string").withColumns({"n": F.lit(1), "text": F.lit("old")})).collect()
    assert {r["page_id"]: r["text"] for r in got} == {1: want, None: "", 2: ""}


def test_warc(spark, tmp_path):
    pages = [(5, "u", "same"), (3, "u5", "same"), (4, None, "same"), (6, "x", None), (7, "y", ""), (8, "z\n", "é" * 40_000), (9, "w", "WARC/1.1\r\n\r\n0\r\n\r\n"), (None, "n", "same"), (None, "m", "allein"), (10, "q", "zweimal"), (10, "q", "zweimal")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    out = f"file://{tmp_path}/w"
    warc.write_archives(df, out)
    got = warc.read_archives(spark, out).collect()
    assert len(got) == len(pages)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert by[3][0]["record_type"] == "response" and {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {(5, 3), (4, 3), (7, 6), (None, 3)}
    assert by[8][0]["payload"].decode() == "é" * 40_000 and by[8][0]["url"] == "z\n" and by[9][0]["payload"] == b"WARC/1.1\r\n\r\n0\r\n\r\n" and len(by[10]) == 2
    for r in got:
        if r["payload"] is not None:
            assert r["payload_digest"] == warc.sha1_base32(bytes(r["payload"])) and r["payload_bytes"] == len(r["payload"])
    assert by[5][0]["payload_digest"] == warc.sha1_base32(b"same") and by[5][0]["payload_bytes"] == 4
    assert sum("continuation" in rec for rec in warc.page_records(1, "u", "é" * 40_000, 1, False)) >= 4
    clash = df.withColumns({"_first": F.lit(1), "_key": F.lit("k"), "payload": F.lit("p"), "_again": F.lit("z")})
    warc.write_archives(clash, out + "2")
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.read_archives(spark, out + "2").collect()) == sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got)
    warc.write_archives(df.limit(0), out + "0")
    assert warc.read_archives(spark, out + "0").count() == 0
    warc.write_archives(df, out + "1", min_payload=5)
    assert warc.read_archives(spark, out + "1").filter("record_type = 'revisit'").count() == 0


def test_missing_segment_is_found(spark, tmp_path):
    import gzip

    recs = warc.page_records(1, "u", "x" * 50_000, 1, False)
    os.makedirs(tmp_path / "w")
    (tmp_path / "w" / "a.gz").write_bytes(gzip.compress("".join(r + "\n" for k, r in enumerate(recs) if k != 1).encode()))
    with pytest.raises(Exception, match="segments"):
        warc.read_archives(spark, f"file://{tmp_path}/w").collect()


def test_html_article_is_only_a_prior():
    body = "The text of the page is in a plain element and it has the words of the language in it, so that it is long enough to be judged. "
    card = '<article class="card"><p>Read more of this</p></article>'
    assert body.strip() in main_text(f"<div><p>{body * 3}</p><p>{body}</p></div><div>{card * 3}</div>")
    assert main_text(f'<article class="promo"><p>{body}</p></article><div><p>{body * 2}</p></div>') == (body * 2).strip()
    assert main_text(f"<nav><a href=x>menu</a><article><p>{body}</p></article></nav><div><p>{body * 2}</p></div>") == (body * 2).strip()
    assert main_text(f"<form><article><p>{body}</p></article></form>") == body.strip()
    assert main_text(f"<p>{body}</p><article><p>{body * 3}</p><p>{'zeta kappa omega ' * 8}</p></article>").startswith(body.strip())


def test_html_keeps_languages_without_stop_words():
    ru = "Вчера в городе открылась новая библиотека, и жители смогли взять первые книги уже утром следующего дня."
    zh = "昨天这座城市的新图书馆正式开放，" * 8
    pl = "Wczoraj otwarto nowa biblioteke miejska, mieszkancy mogli wypozyczyc pierwsze ksiazki juz nastepnego ranka."
    it = "Ieri mattina e stata inaugurata nel centro cittadino una biblioteca nuova; molti abitanti hanno preso libri gia poche ore dopo."
    for text in (ru, zh, pl, it):
        assert main_text(f"<h1>Titel</h1><div><p>{text}</p><p>{text}</p></div><ul><li><a href=x>{text}</a></li></ul>") == f"Titel\n\n{text}\n\n{text}"
    assert ru in main_text(f"<p>{ru}</p><p>This is the notice of the site and it is in the language of the owner, not of the page.</p>")
    assert main_text("<p>" + "QmFzZTY0" * 50 + "</p>") == ""


def test_html_cues_are_whole_words():
    body = "The text of the page is in a plain element and it has the words of the language in it, so that it is long enough to be judged."
    assert main_text(f'<article><p class="notice-period">{body}</p><div class="social-science"><p>{body}</p></div></article>') == f"{body}\n\n{body}"
    for cue in ("cookie-notice", "notice", "site_nav x", "comments", "ad-slot"):
        assert main_text(f'<p>{body}</p><div class="{cue}"><p>{body}</p></div>') == body
    assert main_text(f"<p>{body}\n      <a href=x>\n        one\n        link   </a></p>").startswith(body)


def test_html_cues_name_the_element_itself():
    b = "The text of the page is in a plain element and it has the words of the language in it, so that it is long enough to be judged well."
    for around in ('class="site has-sidebar"', 'class="single no-sidebar"', 'class="page menu-open"', 'class="sidebar"', 'id="with-footer"', 'class="newsletter-issue"', 'class="comments-open"'):
        assert main_text(f"<div {around}><article><p>{b}</p></article></div>") == main_text(f"<main><section {around}><p>{b}</p></section></main>") == b
    for attrs in ('title="the hidden truth"', 'data-hidden="x"', 'data-role="menu"', "data-class='nav'", "title='class=\"ad\"'", 'class="text" class="ad"'):
        assert main_text(f"<p {attrs}>{b}") == b
    for attrs in ('class="adsbygoogle"', 'class="ad1"', 'class="comment-body"', 'class="user-comment"', 'style="color:red; display:none"', "hidden", "aria-hidden=true", "role=navigation", "id=footer-inner", 'class="ad-300x250"', 'class="side__nav"'):
        assert main_text(f"<p>{b}</p><p>{b}</p><div {attrs}><p>{b}</p></div>") == f"{b}\n\n{b}"
    assert main_text(f'<div class="comments"><p>{b * 3}</p></div><p>{b}</p>') == b  # comments are none however long they are


def test_html_keeps_links_figures_and_short_blocks_of_the_article():
    b = "The text of the page is in a plain element and it has the words of the language in it, so that it is long enough to be judged well."
    page = f'<article><h2><a href="#s">Section title</a></h2><p>{b}</p><p><a href=x>{b}</a></p><ul><li><a href=a>Source one</a><li><a href=b>Source two</a></ul></article>'
    assert main_text(page) == f"Section title\n\n{b}\n\n{b}\n\nSource one\n\nSource two"
    assert main_text("<h1>Rezept</h1><p>Zwei Eier.</p><p>Mehl und Zucker.</p><p>Backen.</p>") == "Rezept\n\nZwei Eier.\n\nMehl und Zucker.\n\nBacken."
    figures = "12 45 1999 2003 2004 55.1 66.2 77.3 88.4 99.5 100 1200 1300 1400 1500 1600 1700 1800"
    assert main_text(f"<p>{b}</p><p>{figures}</p><p>{b}</p>") == f"{b}\n\n{figures}\n\n{b}"


def test_html_unclosed_and_inline_elements():
    b = "The text of the page is in a plain element and it has the words of the language in it, so that it is long enough to be judged well."
    assert main_text(f'<p class="ad">Buy now<div><h1>Head</h1><p>{b}</p></div>') == f"Head\n\n{b}"
    assert main_text(f'<table><tr><td class="sidebar">menu<td>{b}</table>') == main_text(f"<dl><dt class=nav>a<dd>{b}</dl>") == b
    assert main_text(f'<article><p>One <span class="ad">Buy now</span> two {b}</p></article>') == f"One two {b}"
    assert main_text(f'<article><p>One <span class="ad">Buy now</p><p>{b}</p></article>') == f"One\n\n{b}"
    assert main_text(f"<ul><li>eins<li>zwei<ul><li>drei</ul><li>vier</ul><p>{b}</p>") == f"eins\n\nzwei\n\ndrei\n\nvier\n\n{b}"


def test_html_pages_without_an_article_element():
    """Generated pages whose true text is known: text in plain elements between menus, adverts, notices, comments and footers."""
    r = random.Random(12)
    words = "the of and to in is that it was for on with as by at from this which had not are but his they were her she there would their".split()
    nouns = "river library council museum engine harvest letter border market winter archive bridge village harbour teacher season".split()
    sentence = lambda n: " ".join(r.choice(words) if r.random() < 0.55 else r.choice(nouns) for _ in range(n)).capitalize() + "."
    junk = [
        lambda: "<nav><ul>" + "".join(f"<li><a href='/{x}'>{x.title()}</a>" for x in r.sample(nouns, 4)) + "</ul></nav>",
        lambda: f"<div class='{r.choice(['sidebar', 'widget', 'related-posts', 'social-links', 'newsletter-signup'])}'><p>{sentence(20)}</p><a href=x>More</a></div>",
        lambda: f"<div class='{r.choice(['ad-slot', 'adsbygoogle', 'advert', 'ad-300x250'])}'>{sentence(15)}</div>",
        lambda: f"<div id=cookie-notice><p>{sentence(25)}</p><button>OK</button></div>",
        lambda: f"<section class='comments'><div class='comment'><p>{sentence(30)}</p></div></section>",
        lambda: f"<footer><p>{sentence(18)}</p></footer>",
        lambda: f"<script>var x = '<p>{sentence(9)}</p>';</script><!-- {sentence(6)} -->",
        lambda: f"<form><label>{sentence(4)}</label><input name=q></form>",
    ]
    for _ in range(150):
        paragraphs = [sentence(r.randint(16, 60)) for _ in range(r.randint(3, 8))]
        for _ in range(r.randint(0, 2)):
            paragraphs.insert(r.randint(1, len(paragraphs) - 1), r.choice(["A short aside.", "Part two", "1999, 2004, 2011"]))
        end = r.choice(["</p>", ""])
        inner = [f"<p class='{r.choice(['text', 'lead', 'no-menu', 'x'])}'>{p}{end}" for p in paragraphs]
        body = f"<div class='{r.choice(['content', 'page has-sidebar', 'post menu-open', 'wrapper'])}'>{''.join(inner)}</div>"
        before, after = "".join(j() for j in r.sample(junk, r.randint(0, 4))), "".join(j() for j in r.sample(junk, r.randint(0, 4)))
        assert main_text(f"<html><body class='{r.choice(['home', 'has-footer'])}'>{before}{body}{after}</body></html>") == "\n\n".join(paragraphs)


def test_html_is_linear_in_hostile_pages():
    import time

    for page in ("<a " * 100_000, "<a " * 100_000 + ">", "<a '\"" * 60_000, "<a \">\"" * 60_000, "<div>" * 3000 + "</p></b>" * 30_000, "<!--" * 50_000, "<script>" * 50_000, "<article>" * 20_000, "<p class='" * 50_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 2, page[:20]
    assert main_text("before the <!-- never closed > end") == main_text("before the ") and "tail" in main_text("<p>x</p> tail < of the text and it is all of the page that there is in here")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{src}/benchmark.parquet").collect()]
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, kept, src)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        before, kept = {r["doc_id"]: r["text"] for r in kept.collect()}, spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        if name == "exact dedup":
            norm = lambda t: "".join((t or "").split())
            assert len(after) == len({norm(t) for t in before.values()}) == len({norm(t) for t in after.values()})
        if name == "benchmark decontamination":
            assert set(after) == {i for i, t in before.items() if not brute.overlap(t, bench)[1]}
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept, src)
    assert 0 < mixed.count() <= kept.count() and mixed.filter("taken <> copies * size").count() == 0
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), src).count() == 0, name


def test_pipeline_awkward_rows(spark, docs, odd):
    import corpus_pipeline

    d = odd.selectExpr("doc_id", "text", "'de' AS lang", "source", "length(text) AS n_chars")
    assert corpus_pipeline.language(spark, d.unionByName(d.limit(0)), "/root/testdata/sf0.001").count() == 5
    assert corpus_pipeline.exact_copies(spark, d, "").count() == 4
    assert corpus_pipeline.near_copies(spark, d, "").filter("doc_id = 7").count() >= 1
    assert hashlib.sha256(b"").hexdigest() == brute.sha(b"")
