"""Cases in which results differed from the SQL, or work outgrew its input."""

import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from annalist.catalog import corpus, sources
from annalist.catalog import dating as catalog_dating
from annalist.catalog import facts as catalog_facts
from annalist.catalog import text as catalog_text
from annalist.catalog import vectors as catalog_vectors
from annalist.catalog.corpus import segments
from annalist.functions import parsers
from annalist.functions import text as T
from annalist.functions.parsers import _chunks
from annalist.operators import blocks, components, dating, entities, facts, search, vectors
from annalist.operators import providers as P
from annalist.plans import tables
from annalist.plans.numbering import numbered
from annalist.plans.staging import stage
from annalist.sources import articles
from annalist.streaming.ingest import ingest_vault


def test_name_chunks_part_no_word(spark):
    assert _chunks("aa bb Theran cc", 9, whole=True) == ["aa bb", "Theran cc"]
    assert _chunks("ab###cdef ghi", 6, whole=True) == ["ab###", "cdef", "ghi"]
    assert _chunks("abcdefghij kl", 4, whole=True) == ["abcdefghij", "kl"]
    rows = spark.createDataFrame([(1, "x" * 1996 + " Theran"), (2, "x" * 1996 + " The and"), (3, "x" * 1997 + " The and"), (4, "y" * 1997 + "The and The")], "doc_id int, text string")
    got = P.extract_mentions(rows, "doc_id", "text", P.DictionarySpans({"The": "Konzept"})).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == {2: 1, 3: 1, 4: 1}


def test_chunks_without_python(spark):
    r = random.Random(5)
    long = ["x" * 30, " " * 40, "a. b" + " " * 30, " " * 12 + "a. b", ". " * 20, "😀a" * 99, "a.\n" * 9, "ab\u00a0" * 9, "ab. \x1c\u3000" * 9, "wort. " * 2000]
    texts = [None, "", " ", " a ", *long, *("".join(r.choice("ab.. \n\u00a0😀é") for _ in range(r.randrange(60))) for _ in range(400))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    for most in (1, 2, 5, 9, 8000):
        got = rows.select("i", parsers.chunk_sentences("t", most).alias("c"))
        assert not re.search("Python|Arrow", got._jdf.queryExecution().executedPlan().toString().split("Exchange")[0])
        assert {x["i"]: x["c"] for x in got.collect()} == {i: _chunks(t or "", most) for i, t in enumerate(texts)}, most
    mixed = "😀a" * 20000 + ". b" * 3000  # signs of unequal width: no step is recursive
    assert spark.createDataFrame([(mixed,)], "t string").select(parsers.chunk_sentences("t", 8000)).first()[0] == _chunks(mixed, 8000)


def test_chunks_are_stripped_as_in_sql(spark, tmp_path):
    texts = [None, "", "  ", " a ", "\ta\u00a0 ", "a. b\u00a0 \n" * 400, "  " + "wort. " * 700, " " * 2500, "x" * 4100 + " \v", "a. b" + " " * 3000 + "\u00a0c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, catalog_text.s_chunk_sentences(spark, str(tmp_path)).collect())) == sorted(con.execute(catalog_text.C.sql["s_chunk_sentences"]).fetchall())


def test_citations_with_ascii_bounds(spark):
    row = spark.createDataFrame([("éèê ouenèle éeauletion, 84.26.86.227 und (BZ, 1.2.2003)",)], "t string")
    got = row.select(*[f(F.col("t"), a) for a in (False, True) for f in (T.citation_names, T.citation_dates)]).first()
    assert tuple(got) == ("BZ", "1.2.2003", "eauletion;BZ", "84.26.86;1.2.2003")


def test_docx_of_documents_without_a_shuffle(spark, tmp_path):
    rows = [(1, "eins\n1999\nBZ, 1.2.2003 \x01<&>\nvier"), (2, None), (3, "")]
    spark.createDataFrame([(i, "de", "src1", t) for i, t in rows], "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    files = sources.docx_files(sources.styled(spark, str(tmp_path)))
    assert "Exchange" not in files._jdf.queryExecution().executedPlan().toString()
    want = segments(spark, str(tmp_path)).selectExpr("doc_id", "pos", "trim(translate(CASE WHEN pos % 27 = 0 THEN 'Notizen' ELSE text END, '\x01', '')) AS text").filter("text <> ''")
    got = sources.paragraphs(spark, str(tmp_path)).select("doc_id", "pos", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5


def test_packed_vault_has_few_files_and_is_read_once(spark, tmp_path):
    vault, out, done = (str(tmp_path / n) for n in ("vault", "out", "done"))
    docs = spark.range(300).selectExpr("id AS doc_id", "'de' AS lang", "'src1' AS source", "concat('Text\n---\n', id) AS text")
    came = []
    for rows in (docs.filter("doc_id < 100"), docs.filter("doc_id >= 100"), None):
        if rows is not None:
            sources.write_vault(rows.coalesce(2), vault)
        came.append(ingest_vault(spark, vault, out, done, packed=True))
    assert came == [100, 200, 0] and len(list((tmp_path / "vault").rglob("*.parquet"))) <= 4
    got, want = (sources._vault_rows(x) for x in (spark.read.parquet(out), articles.article_segments(articles.read_packed_vault(spark, vault))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.select("doc").distinct().count() == 300


def test_vectors_are_copied_as_often_at_any_size():
    copies = [-(-n // blocks.block_rows(n, vectors.BLOCK_ROWS, vectors.MOST_ROWS)) for n in (20_000, 200_000, 1_000_000)]
    assert copies == [16, 16, 16] and blocks.block_rows(10, 4096, 16384) == 4096 and blocks.block_rows(10**6, 4096, 16384) == 16384


def test_forest_links_what_all_pairs_link(spark, monkeypatch):
    g = np.random.default_rng(4)
    v = g.normal(size=(5, 8))[g.integers(0, 5, 200)] + 0.5 * g.normal(size=(200, 8))
    rows = spark.createDataFrame([(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 60)
    every, few = (vectors.close_pairs(rows, "k", 0.8, forest=f) for f in (False, True))
    whole = {r["node"]: r["component"] for r in components.connected_components(every).collect()}
    assert 0 < few.count() < every.count() / 4 and len(set(whole.values())) > 1
    assert {r["node"]: r["component"] for r in components.connected_components(few).collect()} == whole
    assert {r["k"]: r["cluster"] for r in vectors.dbscan(rows, "k", 0.8).collect()} == {i: whole.get(i) for i in range(200)}
    assert {r["k"]: r["cluster"] for r in vectors.dbscan(rows, "k", 0.8, 1).collect()} == {i: whole.get(i, i) for i in range(200)}


def test_postings_are_made_by_block(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ROWS", 4)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["abcab", "ab", "", None, "xabc\nü", "bca"])], "id long, text string")
    index = search.build_index(rows, ["id"])
    got = {(r["gram"], r["_block"]): r["places"] for r in index.postings.collect()}
    assert got == {("abc", 0): [0], ("bca", 0): [0], ("cab", 0): [0], ("ab", 0): [1], ("", 0): [2, 3], ("xab", 1): [0], ("abc", 1): [0], ("bc\n", 1): [0], ("c\nü", 1): [0], ("bca", 1): [1]}
    assert sorted(r["id"] for r in index.matching(["abc"]).collect()) == [0, 4]


def test_names_beyond_an_automaton_are_joined(spark, monkeypatch):
    known = [(0, "Haus am See", ["see"]), (1, "C++", []), (2, "§§", []), (3, "ι", []), (4, "Ünal", ["x_1"]), (5, "αιβ", ["(neu)"]), (6, "see", []), (7, "α", []), (8, "..", ["Am"])]
    texts = ["Das haus AM see.", "Haus amSee, see_ und Seen", "c++ und C+++", "§§ 12 §§§", "ᾳ ᾳβ ΑΙΒ ΑΙΒΑ", "ünal, X_1 (NEU)", "(neu)x", "α.. am", "", None, "ͅ ι", "αι", "§§" * 400, "ᾳ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    ents = spark.createDataFrame(known, "ord long, normalform string, aliases array<string>")
    plain = entities.NameAutomaton([(o, n, a) for o, n, more in known for a in (n, *more)])
    want = {i: [f for _, f in plain.find(t)] for i, t in enumerate(texts)}
    monkeypatch.setattr(entities, "PATTERNS", 0)
    monkeypatch.setattr(entities, "AUTOMATON_BYTES", 0)
    monkeypatch.setattr(entities, "WORD_BITS", 1)
    monkeypatch.setattr(entities, "_name_parts", None)  # no list in the tasks
    got = entities.match_entities(rows, ents)
    assert got.columns == ["id", "text", "actors"] and {r["id"]: r["actors"] for r in got.collect()} == want and want[0] == ["Haus am See", "see", ".."]
    one = entities.match_entities(rows, ents.filter("ord IN (4, 6)"))  # words only
    assert {r["id"]: r["actors"] for r in one.collect()} == {i: [f for _, f in plain.find(t) if f in ("Ünal", "see")] if i not in (0,) else ["see"] for i, t in enumerate(texts)}


def test_actor_rows_are_dealt_out_by_size(spark, tmp_path, monkeypatch):
    rows = spark.range(1000)
    assert [tables.dealt_out(rows, "id", n=n, per_task=100).rdd.getNumPartitions() for n in (0, 100, 1001)] == [1, 1, 11]
    rows.selectExpr("id % 300 AS l_orderkey", "id AS l_partkey", "1 AS l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(250).selectExpr("id AS o_orderkey", "date'2020-01-01' AS o_orderdate", "'x' AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    seen = []
    monkeypatch.setattr(corpus, "dealt_out", lambda df, *by, n: (seen.append((by, n)), tables.dealt_out(df, *by, n=n, per_task=100))[1])
    got = {r["actor"]: (r["n"], r["entries"]) for r in catalog_facts.a_actor_entries(spark, str(tmp_path)).collect()}
    want = {}
    for i in range(1000):
        if i % 300 < 250:
            want.setdefault(f"p{i % 400}", []).append(i % 300)
    assert got == {a: (len(x), len(set(x))) for a, x in want.items()} and seen == [(("id",), 1000)] * 2


def test_notes_shuffle_no_texts(spark):
    rows = [("heading", "1903"), ("content", "TRıPOLİT um 1911 (1820-1880)"), ("content", "(1950) nichts"), ("content", "Mitte des 19. Jahrhunderts"), ("content", "im 20. Jh.x"), ("content", "WK 1 kam"), ("content", "17777 20299 x1999y")]
    segs = spark.createDataFrame([(1, i, t, x) for i, (t, x) in enumerate(rows)], "doc_id int, pos int, type string, text string")
    got = dating.date_notes(segs).select("pos", "time_from", "precision")
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    above = lines[: next(i for i, x in enumerate(lines) if "Exchange" in x)]
    assert not any("regexp_extract_all" in x or "RLIKE" in x for x in above)
    assert sorted(map(tuple, got.collect())) == [(1, 1911, "exact"), (2, 1903, "exact"), (3, None, "decade"), (4, None, "decade"), (5, 1914, "event"), (6, 1999, "exact")]
    named = {(r["span"], r["type"]) for r in dating.date_notes(segs).selectExpr("inline(anchors)").collect()}
    assert {x for x in named if x[1] != "exact"} == {("Tripolit. Krieg", "event"), ("Erster Weltkrieg", "event"), ("20. Jh.", "decade")} | {x for x in named if x[0].startswith("Mitte")}


def test_articles_are_grouped_without_moving_texts_twice(spark, monkeypatch):
    cols = "id long, doc_anchor string, source_name string, url string, text string, event_type string, actors array<string>"
    entries = spark.createDataFrame([(3, "c", "s", None, "z", "k", ["x"]), (1, "a", "s", "", "", "k", ["y", "x"]), (2, "b", None, "u", "w", None, None)], cols)
    moved = []
    monkeypatch.setattr(facts, "numbered", lambda df, *a: (moved.append(df.columns), numbered(df, *a))[1])
    got = facts.group_by_article(entries).orderBy("id").collect()
    assert [(r["id"], r["doc_anchor"], r["text"], r["event_type"], r["actors"]) for r in got] == [(1, "a", "z", "k", ["y", "x"]), (2, "b", "w", None, [])]
    assert all("text" not in m for m in moved) and got[0]["url"] == "" and got[1]["source_name"] is None
    segs = spark.createDataFrame([("1-0", 1, 0, "t", "line", None, 1900, "exact", "s", "u")], "segment_id string, doc_id int, pos int, text string, line string, date string, time_from int, precision string, source string, url string")
    facts.build_entries(segs, spark.createDataFrame([], "segment_id string, category string, confidence string, actors array<string>")).count()
    assert "line" not in moved[-1]


def test_top_years_look_for_years_once(spark, tmp_path):
    spark.createDataFrame([(1, "de", "s", "a 1999 (1950) 1999\nKapitel 1888")], "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog_dating.a_anchor_top_years(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Tanzimat" not in plan and "decade" not in plan and plan.count("20[0-2][0-9])(?![0-9])") <= 1
    assert {r["year"]: r["n"] for r in got.collect()} == {1888: 1}


def test_sides_of_words_take_one_shuffle(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c c"), (3, None), (4, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog_vectors.u_intersect_except(spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect())) == [("", "gone"), ("a", "new"), ("b", "stayed"), ("c", "gone")]


def test_refinement_joins_no_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i < 3), float(i >= 3)], "wort mehr") for i in range(6)], "k int, v array<double>, text string")
    labels = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "ord int, c array<double>")
    staged = []
    monkeypatch.setattr(P, "stage", lambda df, name: (staged.append((name, df.columns)), stage(df, name))[1])
    got, moves = P.refine(rows, labels, "k", "text", P.HashingEmbedder(2), steps=3, every=20, between=True)
    assert {r["k"]: r["label"] for r in got.collect()} == {i: int(i >= 3) for i in range(6)} and moves == [0.0]
    assert [n for n, _ in staged].count("refine") == 1 and not any("label" in c for _, c in staged)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "")
