"""Cases of the fourth round in which work outgrew its input, or a step of a method was missing."""

import duckdb
import numpy as np

from annalist.catalog import facts as catalog_facts
from annalist.catalog import sources
from annalist.catalog import vectors as catalog_vectors
from annalist.operators import blocks, entities
from annalist.operators import providers as P
from annalist.operators import tfidf, vectors
from annalist.plans.staging import stage


def test_refinement_weighs_words_once_and_writes_no_labels(spark, monkeypatch):
    g = np.random.default_rng(6)
    v = g.normal(size=(60, 8)) + 1.5 * np.eye(8)[np.arange(60) % 3]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist(), f"wort{'abc'[i % 3]} mehr") for i, x in enumerate(v)], "k int, v array<double>, text string")
    labels = spark.createDataFrame([(i, np.eye(8)[i + 1].tolist()) for i in range(4)], "ord int, c array<double>")
    staged, weighed = [], []
    monkeypatch.setattr(P, "stage", lambda df, name: (staged.append(name), stage(df, name))[1])
    once = tfidf.weights
    monkeypatch.setattr(tfidf, "weights", lambda *a, **k: (weighed.append(1), once(*a, **k))[1])

    class Fixed:
        def encode(self, texts):
            return np.array([np.eye(8)["abc".index(t.split("wort")[1][0])] + 0.1 if "wort" in t else np.ones(8) for t in texts])

    for most in (P.MOST_SUMS, 0):  # added up by the driver, and by Spark
        monkeypatch.setattr(P, "MOST_SUMS", most)
        got, moves = P.refine(rows, labels, "k", "text", Fixed(), steps=8, every=3, change=0.0, stability=0.9, between=True)
        assert staged == ["refine", "words"] and weighed == [1]
        now, last, want = np.eye(8)[1:5], None, []
        for step in range(1, 9):
            at = (v @ now.T).argmax(1)
            want += [] if last is None else [float((at != last).mean())]
            last = at
            if step % 3:
                now = np.stack([v[at == j].mean(0) / np.linalg.norm(v[at == j].mean(0)) if (at == j).any() else now[j] for j in range(4)])
            else:  # the commonest word of each label, by its weights
                n = np.array([[((at == j) & (np.arange(60) % 3 == x)).sum() for x in range(3)] for j in range(4)])
                new = np.eye(8)[n.argmax(1)] + 0.1
                now = np.where(n.any(1)[:, None], new / np.linalg.norm(new, axis=1, keepdims=True), now)
        seen = [m for m in want if m]
        assert [m for m in moves if m] == seen and seen and {r["k"]: r["label"] for r in got.collect()} == dict(enumerate(last.tolist()))
        staged.clear()
        weighed.clear()
    same = np.array([[1.0, 2.0], [2.0, 1.0], [1.0, 2.0]])
    assert vectors.best_label(np.array([[1.0, 3.0], [3.0, 1.0], [0.0, 0.0], [1.0, 1.0]]), same).tolist() == [0, 1, 0, 0]


def test_components_link_parts_of_blocks(spark, monkeypatch):
    g = np.random.default_rng(8)
    v = np.concatenate([g.normal(size=(5, 8))[g.integers(0, 5, 160)] + 0.4 * g.normal(size=(160, 8)), g.normal(size=(60, 8)), np.tile(g.normal(size=8), (9, 1)), np.zeros((2, 8))])
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    v = v[g.permutation(len(v))]
    for low, names in ((0.7, [f"k{i:03d}" for i in range(len(v))]), (0.9, list(range(len(v)))), (0.999999, list(range(len(v)))), (-1.0, list(range(len(v))))):
        want = {}
        near = v @ v.T >= low
        for i in range(len(v)):
            todo, seen = [i], {i}
            while todo:
                more = set(np.flatnonzero(near[todo.pop()]).tolist()) - seen
                seen |= more
                todo += more
            want[names[i]] = (names[min(seen)], len(seen))
        df = spark.createDataFrame([(k, x.tolist()) for k, x in zip(names, v, strict=True)], ["k", "v"]).repartition(3)
        linked = []
        cut = vectors.connected_components
        monkeypatch.setattr(vectors, "connected_components", lambda e: (linked.append(stage(e, "e")), cut(linked[-1]))[1])  # noqa: B023
        for rows in (1024, 40):  # one block, and several
            monkeypatch.setattr(vectors, "BLOCK_ROWS", rows)
            assert {r["k"]: r["component"] for r in vectors.similarity_components(df, "k", low).collect()} == {k: c for k, (c, _) in want.items()}
            assert {r["k"]: r["cluster"] for r in vectors.dbscan(df, "k", low).collect()} == {k: c if n > 1 else None for k, (c, n) in want.items()}
        assert linked[0].count() == 0 and linked[2].count() < len(v)  # one block has no parts to link, and others link few
        monkeypatch.setattr(vectors, "connected_components", cut)


def test_bounds_take_one_product(monkeypatch):
    g = np.random.default_rng(3)
    x = g.normal(size=(700, 64)) * np.linspace(2, 0.01, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, sim, full = vectors._meet(x, x, vectors._turned(x), 0.6, 2.0, same=True)
    s = x @ x.T
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(z.tolist() for z in np.nonzero(np.triu(s >= 0.6, 1))), strict=True)) and full < s.size / 4
    i, j, _, few = vectors._meet(x, x, vectors._turned(x), 0.6, 2.0, one=True)
    assert 0 < len(i) < (s >= 0.6).sum() and few < full and all(s[i, j] >= 0.6)


def _view(con, folder, name):
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")


def test_actors_have_their_entries(spark, tmp_path):
    spark.createDataFrame([(1, 5, 1), (1, 5, 2), (2, 405, 1), (3, 6, 1), (9, 6, 1)], "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, "x") for i in (1, 2, 3)], "o_orderkey long, o_orderpriority string").selectExpr("*", "date'2020-01-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog_facts.a_actor_entries(spark, str(tmp_path))
    assert got.columns == ["actor", "n", "entries", "ids"] and sorted(map(tuple, got.collect())) == [("p5", 3, 2, "1,1,2"), ("p6", 1, 1, "3")]
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        _view(con, tmp_path, t)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(catalog_facts.C.sql["a_actor_entries"]).fetchall())


def test_dbscan_sweeps_and_chooses(spark, tmp_path):
    g = np.random.default_rng(2)
    v = np.concatenate([c + 0.12 * g.normal(size=(12, 16)) for c in g.normal(size=(4, 16))] + [g.normal(size=(6, 16))])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog_vectors.v_dbscan(spark, str(tmp_path))
    rows = sorted(map(str, map(tuple, got.collect())))
    con = duckdb.connect()
    _view(con, tmp_path, "embeddings")
    asked = con.execute(catalog_vectors.C.sql["v_dbscan"])
    assert got.columns == [x[0] for x in asked.description] and rows == sorted(map(str, asked.fetchall())) and len(rows) == len(v) * len(catalog_vectors.EPS)
    chosen = {(r["eps"], r["cluster"]) for r in got.filter("chosen").collect()}
    assert len({e for e, _ in chosen}) == 1 and len(chosen - {(e, None) for e, _ in chosen}) >= 4


def test_words_of_a_block_are_listed_once(spark, monkeypatch):
    known = [(0, "Haus am See", ["see"]), (1, "C++", []), (2, "Ünal", ["x_1"]), (3, "αιβ", []), (4, "Haus", [])]
    texts = ["Das haus AM see.", "seen C++", "ünal X_1", "ΑΙΒ", None, "", "das Hausboot"] * 40
    rows = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)], "id int, text string, more array<int>").repartition(2)
    ents = spark.createDataFrame(known, "ord long, normalform string, aliases array<string>")
    plain = entities.NameAutomaton([(o, n, a) for o, n, more in known for a in (n, *more)])
    monkeypatch.setattr(entities, "PATTERNS", 0)
    monkeypatch.setattr(entities, "AUTOMATON_BYTES", 0)
    for bits in (22, 4, 0):
        monkeypatch.setattr(entities, "WORD_BITS", bits)
        staged = []
        monkeypatch.setattr(entities, "stage", lambda df, name: (staged.append(stage(df, name)), staged[-1])[1])  # noqa: B023
        got = entities.match_entities(rows, ents)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan and "Generate" not in plan  # no entry for each place of a word
        assert {r["id"]: (r["more"], r["actors"]) for r in got.collect()} == {i: ([i], [f for _, f in plain.find(t)]) for i, t in enumerate(texts)}
        blocks = staged[-1].select("_block").distinct().count()
        assert blocks == 2 if bits == 22 else blocks > 20


def test_distances_are_added_in_place(monkeypatch):
    g = np.random.default_rng(7)
    own, v, member = g.normal(size=(37, 9)), g.normal(size=(53, 9)), g.integers(0, 2, (53, 4)).astype(float)
    v[5:9] = own[3:7]
    v[9] = own[9] + 1e-9
    want = np.sqrt(((own[:, None] - v[None]) ** 2).sum(-1)) @ member
    for tile in (512, 8, 1):
        monkeypatch.setattr(blocks, "TILE_ROWS", tile)
        sums = np.ones((37, 4))
        blocks.add_distances(sums, own, v, member)
        assert np.allclose(sums - 1, want, rtol=1e-13, atol=0)


def test_vote_fits_rows_once(spark, tmp_path, monkeypatch):
    g = np.random.default_rng(5)
    v = g.normal(size=(3, 4))[g.integers(0, 3, 60)] + 0.1 * g.normal(size=(60, 4))
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(sources, "GAP_KS", range(2, 6))
    fits = []
    monkeypatch.setattr(vectors, "inertias", lambda jobs: (fits.extend(jobs), [60.0 / k for _, k, _ in jobs])[1])
    assert sources.v_k_vote(spark, str(tmp_path)).columns == ["k", "n"] and len(fits) == 11 * 4
