"""Trigram index, name automaton, core numbers, greedy matching, close pairs and silhouettes against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.operators import blocks, entities, graph, search, vectors


@pytest.fixture(scope="module")
def lines(spark):
    r = random.Random(6)
    words = ["Über", "titel", "(1984)", "nicht", "im", "Jahr", "jahre", "ab", "xyz", "É", "ßen", "Balkan"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 7)))) for i in range(700)] + [(700, None), (701, "a"), (702, ""), (703, "AB")]
    return rows, spark.createDataFrame(rows, "id long, text string").repartition(4)


def test_index_finds_what_a_scan_finds(lines, monkeypatch):
    rows, df = lines
    monkeypatch.setattr(search, "BLOCK_ROWS", 64)
    monkeypatch.setattr(search, "SHARD_BLOCKS", 2)
    index = search.build_index(df, ["id"])
    for words in (["nicht im jahr", "(19"], ["balkan", "balkan", "ß"], ["a"], ["", "xyz"], ["zzz", "titel (1984) jahr"], []):
        low = {i: (t or "").lower() for i, t in rows}
        want = {i: sum(w in t for w in words) for i, t in low.items() if any(w in t for w in words)}
        got = index.matching(words)
        assert {r["id"]: r["score"] for r in got.collect()} == want and got.columns == ["id", "text", "score"]
        assert [r["id"] for r in search.top_indexed(index, words, 5).collect()] == [r["id"] for r in search.top_entries(df, words, 5).collect()] == sorted(want, key=lambda i: (-want[i], i))[:5]
    assert index.share_read(["nicht im jahr"]) < 0.1 < 0.8 < index.share_read(["a", "i", "n", "x", "e"])
    assert search.build_index(df.limit(0), ["id"]).matching(["a"]).count() == 0


def test_index_reads_few_row_groups(spark, lines):
    _, df = lines
    index = search.build_index(df, ["id"])
    plan = index.postings.filter(F.col("gram").isin(["xyz"]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan or "PushedFilters: [IsNotNull(gram), EqualTo(gram,xyz)]" in plan


def test_many_names_are_found_as_by_patterns(spark, monkeypatch):
    r = random.Random(4)
    real = ["Über", "§§", "New York", "york", "ß", "İstanbul", "C++", "a", "A.B", "12", "Straße", "ΣΊΣΥΦΟΣ", "x_y", "ſ", "Kelvin", "²"]
    texts = [None, "", "in Berlin", "STRASSE straße", "σίσυφος ΣΊΣΥΦΟς", "new york, yorker", "c++ C+", "Kelvin s S", "x_y x y"]
    texts += [" ".join(r.choice([*real, "und", ".", ",", "yorkshire", "über-", "(a)"]).swapcase() + r.choice(["", "x", "!"]) for _ in range(12)) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    known = spark.createDataFrame([(i, n, [n.lower()] if i % 3 else [real[i - 1], None, " "]) for i, n in enumerate(real)], "ord long, normalform string, aliases array<string>")
    want = {x["id"]: x["actors"] for x in entities.match_entities(rows, known).collect()}
    assert any(len(v) > 3 for v in want.values())
    many = known.unionByName(spark.range(100, 50_100).select(F.col("id").alias("ord"), F.concat(F.lit("qq"), F.col("id").cast("string"), F.lit("x")).alias("normalform"), F.array().cast("array<string>").alias("aliases")))
    found = entities.match_entities(rows, many)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(found) == exchanges(rows)
    assert {x["id"]: x["actors"] for x in found.collect()} == want
    monkeypatch.setattr(entities, "PATTERNS", 3)
    monkeypatch.setattr(entities, "NAME_BYTES", 0)
    monkeypatch.setattr(entities, "AUTOMATON_BYTES", 400)  # several automata, some by the names' next signs
    assert len(list(entities._name_parts(known.select("ord", "normalform", F.explode("aliases").alias("name")).filter("name IS NOT NULL").withColumn("_bytes", F.length("name") * 80)))) > 3
    assert {x["id"]: x["actors"] for x in entities.match_entities(rows, known).collect()} == want


def cores_by_hand(edges):
    core, left, k = {}, list(edges), 0
    nodes = {x for e in edges for x in e}
    while nodes:
        degree = {x: 0 for x in nodes}
        for a, b in left:
            degree[a] += 1
            degree[b] += 1
        low = {x for x in nodes if degree[x] <= k}
        if not low:
            k += 1
            continue
        core |= dict.fromkeys(low, k)
        nodes -= low
        left = [e for e in left if not low & set(e)]
    return core


@pytest.mark.parametrize("tail", [1 << 20, 0])
def test_core_numbers(spark, monkeypatch, tail):
    monkeypatch.setattr(graph, "TAIL_EDGES", tail)
    r = random.Random(2)
    edges = [tuple(sorted(r.sample(range(30), 2))) for _ in range(110)] + [(100, 101)] * 3 + [(i, i + 1) for i in range(200, 208)]
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "a string, b string")
    assert {x["actor"]: x["core"] for x in graph.core_numbers(df).collect()} == {f"n{x}": k for x, k in cores_by_hand(edges).items()}
    assert graph.core_numbers(df.limit(0)).count() == 0


def test_long_path_has_no_2_core(spark):
    e = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(2001).select(F.col("id").alias("actor"))
    assert graph.k_core(e, nodes).count() == 0 and graph.k_core(e, nodes, 1).count() == 2001
    ring = e.unionByName(spark.createDataFrame([(2000, 0)], "a long, b long"))
    assert graph.k_core(ring, nodes).count() == 2001 and graph.k_core(ring, nodes.filter("actor <> 7")).count() == 0


def test_greedy_pairs_go_on_to_the_end(spark):
    n = 21  # a chain of rising similarity: only its last pair is the best of both ends at first
    pairs = spark.createDataFrame([(i, i + 1, i / 1000) for i in range(n)], "a long, b long, sim double")
    assert sorted(x["a"] for x in entities.greedy_pairs(pairs).collect()) == list(range(0, n, 2))


def test_few_close_pairs_are_multiplied_in_full(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sc = spark.sparkContext
    full, every = sc.accumulator(0), sc.accumulator(0)
    got = {(r["a"], r["b"]): r["sim"] for r in vectors.close_pairs(v, "vec_id", 0.4, compared=(full, every)).collect()}
    x = np.array([r["v"] for r in v.orderBy("vec_id").collect()])
    s = x @ x.T
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.4, 1)), strict=True)}
    assert set(got) == want and all(sim == pytest.approx(s[p]) for p, sim in got.items())
    assert every.value >= len(x) * (len(x) - 1) // 2 and full.value < every.value / 3


def test_meet_is_exact():
    g = np.random.default_rng(3)
    for d in (1, 3, 20, 64):
        x, y = g.normal(size=(90, d)) * g.choice([0.01, 1, 50], size=(90, 1)), g.normal(size=(70, d))
        y[:5] = x[:5]
        s = x @ y.T
        for low, high in ((0.4, 2.0), (-1.0, 0.3), (s.max(), 1e9), (1e9, 2e9)):
            i, j, sim, _ = vectors._meet(x, y, vectors._turned(x), low, high)
            exact = np.array([[(a * b).sum() for b in y] for a in x])
            assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(z.tolist() for z in np.nonzero((exact >= low) & (exact <= high))), strict=True))
            assert np.array_equal(sim, exact[i, j])


def silhouette_by_hand(d, lab):
    out = []
    for i in range(len(lab)):
        own = [d[i, j] for j in range(len(lab)) if lab[j] == lab[i] and j != i]
        a, b = np.mean(own) if own else None, min(np.mean([d[i, j] for j in range(len(lab)) if lab[j] == c]) for c in set(lab) - {lab[i]})
        out.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(out)


def test_silhouettes(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 25)
    monkeypatch.setattr(blocks, "TILE_ROWS", 6)
    g = np.random.default_rng(8)
    v = np.concatenate([g.normal(size=(30, 5)) + 3 * np.eye(5)[0], g.normal(size=(25, 5)), np.tile([1.0, 2, 3, 4, 5], (6, 1)), g.normal(size=(1, 5)), np.zeros((2, 5))])
    lab = ["a"] * 30 + ["b"] * 25 + ["c"] * 6 + ["d"] + ["b"] * 2
    df = spark.createDataFrame([(f"k{i}", x.tolist(), c) for i, (x, c) in enumerate(zip(v, lab, strict=True))], "k string, v array<double>, c string").repartition(3)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    cos = 1 - unit @ unit.T
    np.fill_diagonal(cos, 0)
    assert vectors.silhouette(df, "c", "k").first()[0] == pytest.approx(silhouette_by_hand(d, lab))
    assert vectors.silhouette(df, "c", "k", "cosine").first()[0] == pytest.approx(silhouette_by_hand(cos, lab))
    for m in ("euclidean", "cosine"):
        assert vectors.silhouette(df.filter("c = 'a'"), "c", "k", m).first()[0] is None and vectors.silhouette(df.limit(0), "c", "k", m).first()[0] is None
    scores = lambda *s: spark.createDataFrame(list(enumerate(s, 2)), "k int, score double")
    pick = lambda *s: vectors.guarded_elbow(scores(*s)).first()["k"]
    assert (pick(0.1, 0.3, 0.31, 0.9), pick(0.5, 0.4), pick(0.1, 0.2, 0.3), pick(0.1)) == (3, 2, 4, 2)


def test_silhouettes_of_several_ways_send_rows_once(spark, monkeypatch):
    assert blocks.stream_blocks(10_256, 139) == blocks.stream_blocks(615_384, 139) == blocks.STREAM_BLOCKS  # a row is sent as often at any size
    assert blocks.stream_blocks(0, 64) == blocks.stream_blocks(100, 139) == 1 and blocks.stream_blocks(1 << 20, 4096) == 256  # memory stays bounded
    g = np.random.default_rng(9)
    v = np.concatenate([g.normal(size=(40, 4)), g.normal(size=(20, 4)) + 2, np.ones((5, 4))])
    ways = {"c": [i % 3 for i in range(65)], "d": ["x" if i < 40 else "y" if i < 64 else "z" for i in range(65)], "e": [None if i % 4 == 0 else i % 2 for i in range(65)], "f": [7] * 65}
    df = spark.createDataFrame([(i, x.tolist(), *lab) for i, (x, *lab) in enumerate(zip(v, *ways.values(), strict=True))] + [(None, [9.0] * 4, 0, "x", 1, 7)], "k long, v array<double>, c int, d string, e int, f int").repartition(3)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    some = [i for i, x in enumerate(ways["e"]) if x is not None]
    want = (silhouette_by_hand(d, ways["c"]), silhouette_by_hand(d, ways["d"]), silhouette_by_hand(d[np.ix_(some, some)], [ways["e"][i] for i in some]))
    for tile, cells in ((512, 1 << 24), (4, 100)):  # one block, and several
        monkeypatch.setattr(blocks, "TILE_ROWS", tile)
        monkeypatch.setattr(blocks, "MOST_CELLS", cells)
        got = vectors.silhouettes(df, list(ways), "k").first()
        assert tuple(got)[:3] == pytest.approx(want) and got["f"] is None and got.__fields__ == list(ways)
    labelled, names = vectors.kmeans_each(df.filter("k IS NOT NULL"), "k", (2, 4))
    each = {r["k"]: (r["k2"], r["k4"]) for r in labelled.collect()} if names == ["k2", "k4"] else {}
    assert len(each) == 65
    for j, k in enumerate((2, 4)):
        assert {r["k"]: r["cluster"] for r in vectors.kmeans(df.filter("k IS NOT NULL"), "k", k).collect()} == {key: c[j] for key, c in each.items()}


def test_word_boundaries():
    a = entities.NameAutomaton([(0, "SPD", "SPD"), (1, "BER", "BER"), (2, "Ü", "ü"), (3, "SPD", "spd")])
    assert a.find("Die spd-Fraktion, Berlin") == [(0, "SPD"), (3, "SPD")] and a.find("BER_1 xÜ Ü.") == [(2, "Ü")] and a.find(None) == a.find("") == entities.NameAutomaton([]).find("x") == []
    assert all(a.in_word[c] == bool(re.fullmatch(r"\w", c)) for c in "aZ9_é-. ²")
