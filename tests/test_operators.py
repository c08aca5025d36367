"""Literal cases of the reference's unit tests, as rows."""

import io
import os
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F

from annalist.functions import parsers
from annalist.functions import text as T
from annalist.operators import dating, entities, facts, graph, providers, search, vectors
from annalist.operators.components import connected_components
from annalist.sources import articles, docx
from annalist.streaming.ingest import ingest_vault

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def one(spark, expr, *values):
    """Value of an expression over columns a, b, … of one row."""
    row = spark.createDataFrame([values], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip("abcdef", values, strict=False)))
    return row.select(expr.alias("x")).first()["x"]


def segs(spark, rows):
    """Rows (type, text, date) as one document."""
    return spark.createDataFrame([("d", i, t, x, d) for i, (t, x, d) in enumerate(rows)], "doc_id string, pos long, type string, text string, date string")


def dates(df):
    return [(r["time_from"], r["time_to"], r["precision"]) for r in df.orderBy("pos").collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Im Jahr 1905 begann es", (1905, 1905, "exact")), ("Von 1850 bis 1870", (1850, 1870, "exact")), ("Im frühen 19. Jahrhundert", (None, None, "decade")),
        ("Die Jungtürkenrevolution", (1908, 1908, "event")), ("ohne Hinweis", (None, None, None)), ("Mustafa (1820–1880) lebte", (None, None, None)), ("ein Buch (1923)", (None, None, None)),
        ("Reich (1700–1899) bestand", (1700, 1899, "exact")), ("1898bibliothekswesen", (1898, 1898, "exact")), ("", (None, None, None)),
    ],
)
def test_notes_anchor(spark, text, want):
    assert dates(dating.date_notes(segs(spark, [("content", text, None)]))) == [want]


def test_notes_heading_reset(spark):
    rows = [("heading", "1989", None), ("content", "x", None), ("heading", "Kapitel 1", None), ("content", "y", None)]
    assert dates(dating.date_notes(segs(spark, rows))) == [(1989, 1989, "exact"), (None, None, None)]
    assert dates(dating.date_press(segs(spark, rows))) == [(1989, 1989, "heading"), (1989, 1989, "heading")]


@pytest.mark.parametrize("date,want", [("2005-03-15", 2005), ("2005", 2005), ("2024-11", 2024), ("Frühjahr", None), (None, None)])
def test_press_date_field(spark, date, want):
    assert dates(dating.date_press(segs(spark, [("content", "Text von 1900", date)]))) == [(want, want, "exact" if want else None)]


def test_press_heading_beats_date(spark):
    rows = [("heading", "1989", None), ("content", "a", "2005"), ("heading", "1990", None), ("content", "b", None)]
    assert dates(dating.date_press(segs(spark, rows))) == [(1989, 1989, "heading"), (1990, 1990, "heading")]


def dated(spark, rows):
    return spark.createDataFrame([("d", i, f"s{i}", s, f, t, p, "dummy") for i, (s, f, t, p) in enumerate(rows)], "doc_id string, pos long, segment_id string, source string, time_from int, time_to int, precision string, text string")


U = (None, None, None)


def test_interpolation(spark):
    run = lambda rows: dates(dating.interpolate(dated(spark, rows)))
    assert run([("a", 1990, 1990, "exact"), ("a", *U), ("a", 2000, 2000, "exact")])[1] == (1990, 2000, "interpolated")
    assert run([("a", *U), ("a", 2000, 2000, "exact")])[0] == U
    assert run([("a", 1990, 1995, "exact"), ("a", *U)])[1] == (1992, 1992, "interpolated")
    assert run([("a", *U)]) == [U]
    assert run([("a", 1990, 1990, "exact"), ("b", *U)])[1] == U
    assert run([("a", None, None, "decade"), ("a", *U)])[1] == U
    assert run([("a", 1911, None, "manual"), ("a", *U)])[1] == (1911, 1911, "interpolated")


def test_overrides(spark):
    ov = lambda *rows: spark.createDataFrame(rows, "segment_id string, action string, time_from int, time_to int, text string, ord int")
    base = dated(spark, [("a", 1990, 1990, "exact"), ("a", *U), ("a", *U)])
    got = dating.interpolate(dating.apply_overrides(base, ov(("s1", "set_anchor", 1950, None, "neu", 1), ("s1", "set_anchor", 1960, 1962, None, 2))))
    assert dates(got)[1:] == [(1960, 1962, "manual"), (1961, 1961, "interpolated")]
    got = dating.interpolate(dating.apply_overrides(base, ov(("s0", "undatable", None, None, None, 1))))
    assert dates(got) == [U, U, U] and "undatable" not in got.columns
    assert dates(dating.interpolate(dating.apply_overrides(base, ov().limit(0))))[1][2] == "interpolated"


@pytest.mark.parametrize(
    "raw,want",
    [("Politik", "Politik"), ("Außenpolitik-Entscheidung", "Außenpolitik"), ("xyz", "(unbekannt)"), (None, "(unbekannt)"), ("kultur", "Kultur"), ("", "(unbekannt)")],
)
def test_category(spark, raw, want):
    assert one(spark, T.normalize_category(F.col("a"), ["Politik", "Außenpolitik", "Kultur"]), raw) == want


def test_category_empty_list(spark):
    assert one(spark, T.normalize_category(F.col("a"), []), "Politik") == "(unbekannt)"


@pytest.mark.parametrize(
    "text,want",
    [("Die SPD-Fraktion", ["SPD"]), ("in Berlin", []), ("Das BER.", ["BER"]), ("ber und spd", ["BER", "SPD"]), ("Flughafen Berlin und BER", ["BER"]), ("BERÜ", []), ("a_ber", []), ("", []), (None, [])],
)
def test_match(spark, text, want):
    ents = spark.createDataFrame([(0, "BER", "Ort", ["Flughafen Berlin", "BER"]), (1, "SPD", "Org", []), (2, "", "Org", [])], "ord int, normalform string, typ string, aliases array<string>")
    rows = spark.createDataFrame([(text,)], "text string")
    assert (entities.match_entities(rows, ents).first()["actors"] or []) == want


def test_match_beyond_the_broadcast_bound(spark, monkeypatch):
    ents = spark.createDataFrame([(0, "BER", "Ort", ["Flughafen Berlin"]), (1, "SPD", "Org", [])], "ord int, normalform string, typ string, aliases array<string>")
    rows = spark.createDataFrame([("SPD am Flughafen Berlin",), ("nichts",)], "text string")
    want = [r["actors"] for r in entities.match_entities(rows, ents).orderBy("text").collect()]
    monkeypatch.setattr(entities, "PATTERNS", 0)
    assert [r["actors"] for r in entities.match_entities(rows, ents).orderBy("text").collect()] == want == [["BER", "SPD"], []]


def test_date_js_and_precision(spark):
    assert one(spark, T.date_js(F.col("a"), F.col("b")), "2005-03-15", 1990) == "2005-03-15"
    assert one(spark, T.date_js(F.col("a"), F.col("b")), "März", 1990) == "1990-01-01"
    assert one(spark, T.date_precision(F.col("a")), "interpolated") == "year"
    assert one(spark, T.date_precision(F.lit(None).cast("string")), "x") == "none"
    assert one(spark, T.confidence_abbrev(F.col("a")), "medium") == "med"


def test_page_and_bibliography(spark):
    assert one(spark, T.page_number(F.col("a")), "Text (siehe) 123") == 123
    assert one(spark, T.without_page(F.col("a")), "Text 123") == "Text"
    assert one(spark, T.page_number(F.col("a")), "Text 1234") is None
    assert one(spark, T.is_bibliography(F.col("a")), "Meyer : Titel")
    assert not one(spark, T.is_bibliography(F.col("a")), "nur Text")


def test_keywords_and_route(spark):
    assert one(spark, T.keywords(F.col("a")), "Was war der Balkankrieg und warum der Balkankrieg") == ["balkankrieg", "balkankrieg"]
    assert one(spark, T.asks_model(F.col("a")), "eins zwei drei vier fünf")
    assert not one(spark, T.asks_model(F.col("a")), "eins zwei")
    assert one(spark, T.slug(F.col("a")), " Großes Projekt: 2! ") == "großes_projekt_2"


def test_entries_and_groups(spark):
    seg = dated(spark, [("z", 1990, 1990, "interpolated"), ("z", *U), ("z", *U)]).withColumns({"date": F.lit(None).cast("string"), "url": F.lit("u")})
    cls = spark.createDataFrame([("s0", "B", "medium", ["x", "y"]), ("s1", "A", "high", ["y", "z"])], "segment_id string, category string, confidence string, actors array<string>")
    e = facts.build_entries(seg, cls).orderBy("id")
    assert set(e.columns) == set(facts.REQUIRED)
    rows = e.collect()
    assert [r["id"] for r in rows] == [1, 2, 3] and rows[0]["date_js"] == "1990-01-01" and rows[0]["date_precision"] == "year" and rows[0]["confidence"] == "med" and rows[2]["actors"] == []
    g = facts.group_by_article(e).collect()
    assert len(g) == 1 and g[0]["event_type"] == "B" and g[0]["actors"] == ["x", "y", "z"] and g[0]["text"] == "dummy\n\ndummy\n\ndummy" and g[0]["id"] == 1
    assert {r["field"]: r["missing"] for r in facts.validate_entries(e).collect()}["event_type"] == 1


def test_quality_limits(spark):
    rows = [("rar", "high")] * 19 + [("knapp", "high")] * 20 + [("Anderes", "high")] * 150 + [("sonstiges", "low")] * 151 + [("viel", "high")] * 660
    got = {(r["kind"], r["category"]) for r in facts.quality_report(spark.createDataFrame(rows, "category string, confidence string")).collect()}
    assert got == {("rare", "rar"), ("catch-all", "sonstiges"), ("low", None)}


def test_search_ties_and_repeats(spark):
    e = spark.createDataFrame([(1, "alpha"), (2, "beta alpha"), (3, "gamma"), (4, "alpha")], "id int, text string")
    assert [(r["id"], r["score"]) for r in search.top_entries(e, ["alpha", "alpha", "beta"]).collect()] == [(2, 3), (1, 2), (4, 2)]


def test_graph(spark):
    rows = spark.createDataFrame([(1, "t", "a", 0), (1, "t", "b", 1), (2, "u", "b", 0), (2, "u", "a", 1), (3, "t", "c", 0), (3, "t", "b", 1)], "id int, event_type string, actor string, i int")
    e = graph.edges(rows)
    assert {(r["a"], r["b"], r["event_type"], r["n"]) for r in e.collect()} == {("a", "b", "t", 1), ("a", "b", "u", 1)}
    chain = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    nodes = spark.createDataFrame([(x,) for x in "abc"], "actor string")
    assert graph.k_core(chain, nodes).count() == 0
    ring = chain.union(spark.createDataFrame([("a", "c")], "a string, b string"))
    assert graph.k_core(ring, nodes).count() == 3


def test_runs(spark):
    d = spark.createDataFrame([("x", "2020-01-01"), ("x", "2020-01-03"), ("x", "2020-01-06"), ("x", None)], "k string, d string").withColumn("day", F.col("d").cast("date"))
    assert sorted((str(r["start"]), str(r["stop"])) for r in graph.runs(d, "k", "day", 2).collect()) == [("2020-01-01", "2020-01-03"), ("2020-01-06", "2020-01-06")]


def test_components(spark):
    chain = spark.range(1, 60).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(100, 101), (101, 101), (None, 5)], "a long, b long"))
    got = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    assert connected_components(chain.limit(0)).count() == 0


def test_parsers(spark):
    assert parsers._first_json('x {bad {"a": [1, {"b": 2}]} y') == '{"a": [1, {"b": 2}]}'
    assert parsers._first_json("nothing") is None
    assert parsers._chunks("Eins. Zwei. Drei", 8) == ["Eins.", "Zwei.", "Drei"]
    assert parsers._chunks("abcdefghij", 4) == ["abcd", "efgh", "ij"]
    rows = spark.createDataFrame([(1, "weg\n# Personen\nKaiser, Wilhelm\n# Quatsch\nfort\n# orte\nBonn")], "k int, t string")
    got = parsers.entity_lines(rows, ["k"], "t").orderBy("ord").collect()
    assert [(r["typ"], r["normalform"], r["aliases"]) for r in got] == [("Person", "Kaiser", ["Wilhelm"]), ("Ort", "Bonn", [])]
    tax = parsers.taxonomy_text(spark.createDataFrame([(1, "## 1. **Eins**\nDas ist es\nKeywords: a, b, c, d\n## Zwei")], "k int, t string"), "t").orderBy("ord").collect()
    assert [(r["name"], r["description"], r["keywords"]) for r in tax] == [("Eins", "Das ist es", ["a", "b", "c"]), ("Zwei", "", [])]
    html = spark.createDataFrame([("Der SPD & die spd, Berlinale",)], "t string").select(parsers.highlight({"spd": ("SPD", "Org")}, ["berlin"], "SPD")("t").alias("h")).first()["h"]
    assert html.count("entity-focus") == 2 and "&amp;" in html and "<mark>" not in html


class Flaky:
    """Fails to give JSON at first."""

    def __init__(self):
        self.seen = set()

    def complete(self, prompts):
        out = []
        for p in prompts:
            key = p.rsplit("\n", 1)[-1]
            out.append('```json\n{"category": "politik", "confidence": "high"}\n```' if key in self.seen or key == "gut" else "hm")
            if key != "nie":
                self.seen.add(key)
        return out


def test_classify_retries_once(spark):
    rows = spark.createDataFrame([("gut",), ("zweimal",), ("nie",)], "text string").coalesce(1)
    got = {r["text"]: (r["category"], r["confidence"]) for r in providers.classify_texts(rows, "text", "p", ["Politik"], Flaky()).collect()}
    assert got == {"gut": ("Politik", "high"), "zweimal": ("Politik", "high"), "nie": (None, None)}


def test_vectors(spark):
    v = spark.createDataFrame([(1, 0, [3.0, 4.0]), (2, 0, [0.0, 0.0]), (3, 1, [1.0, 0.0])], "k long, g int, v array<double>")
    n = {r["k"]: r["x"] for r in v.select("k", vectors.normalised(F.col("v")).alias("x")).collect()}
    assert n[1] == pytest.approx([0.6, 0.8]) and n[2] == [0.0, 0.0]
    assert {r["g"]: r["sim"] for r in vectors.intra_similarity(v, "g").collect()}[1] == 1.0
    unit = v.filter("k <> 2").withColumn("v", vectors.normalised(F.col("v")))
    assert [(r["a"], r["b"]) for r in vectors.close_pairs(unit, "k", 0.5).collect()] == [(1, 3)]
    assert vectors.close_pairs(unit, "k", 0.7).count() == vectors.close_pairs(v.limit(0), "k", 0.5).count() == 0


def test_merge_fold_and_greedy(spark):
    rows = [Row(project="p", ord=0, normalform="A", typ="Ort", score=0.1, source="spacy", aliases=["a1"]), Row(project="p", ord=1, normalform="A1", typ="Org", score=0.9, source="llm_full", aliases=["x"]), Row(project="p", ord=2, normalform="B", typ="Org", score=0.2, source="llm_full", aliases=[])]
    got = sorted((r["normalform"], r["typ"], r["score"], sorted(r["aliases"])) for r in entities.merge_entities(spark.createDataFrame(rows)).collect())
    assert got == [("A1", "Ort", 0.9, ["a1", "x"]), ("B", "Org", 0.2, [])]
    more = [("p", 3, "A", "Org", 0.1, "spacy", ["q"]), ("p", 4, "X", "Org", None, "spacy", ["y"]), ("q", 0, "A", "Ort", 0.1, "spacy", None), (None, 9, "A", "Ort", 0.1, "spacy", ["A"]), ("p", 5, " ", "Ort", 0.1, "spacy", ["A"])]
    kind = "project string, ord long, normalform string, typ string, score double, source string, aliases array<string>"
    both = spark.createDataFrame([tuple(r) for r in rows] + more, kind)
    got = {(r["project"], r["ord"]): (r["normalform"], r["aliases"]) for r in entities.merge_entities(both).collect()}
    # the old normal form "A" of the first is no name any more, "x" is
    assert got == {("p", 0): ("A1", ["a1", "x", "y"]), ("p", 1): ("B", []), ("p", 2): ("A", ["q"]), ("q", 0): ("A", []), (None, 0): ("A", ["A"])}
    ents = lambda *r: spark.createDataFrame([(i, n, "Ort", a) for i, (n, a) in enumerate(r)], "ord long, normalform string, typ string, aliases array<string>")
    fate = entities.merge_proposal(ents(("Neu", ["n1"]), ("n1", ["n2"]), ("n2", []), ("Alt", []), ("Weg", []), ("x", ["r"])), ents(("alt", ["Weg2"])), ents(("WEG", ["R"])))
    assert [(r["status"], r["into"]) for r in fate.orderBy("ord").collect()] == [("new", None), ("confirmed", "Neu"), ("confirmed", "Neu"), ("confirmed", "alt"), ("skipped", None), ("skipped", None)]
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.95), (3, 4, 0.8), (1, 4, 0.7)], "a long, b long, sim double")
    assert {(r["a"], r["b"]) for r in entities.greedy_pairs(pairs).collect()} == {(2, 3), (1, 4)}


def test_proposals_against_a_plain_scan(spark):
    import random

    r = random.Random(3)
    name = lambda: r.choice("abcdefghijklmnop") * r.randint(1, 2)
    ents = lambda n: [(i, name(), "Ort", [name() for _ in range(r.randint(0, 2))]) for i in range(n)]
    names = lambda e: {e[1], *e[3]}
    df = lambda x: spark.createDataFrame(x, "ord long, normalform string, typ string, aliases array<string>")
    for _ in range(2):
        seed, rejected, props = ents(4), ents(2), ents(25)
        refused = set().union(*map(names, rejected))
        held, want = [[e[1], names(e)] for e in seed], {}
        for p in props:
            if names(p) & refused:
                want[p[0]] = ("skipped", None)
            elif hit := next((h for h in held if h[1] & names(p)), None):
                hit[1] |= set(p[3])
                want[p[0]] = ("confirmed", hit[0])
            else:
                held.append([p[1], names(p)])
                want[p[0]] = ("new", None)
        assert {x["ord"]: (x["status"], x["into"]) for x in entities.merge_proposal(df(props), df(seed), df(rejected)).collect()} == want


def test_wide_dictionary_finds_the_same(spark, monkeypatch):
    ents = spark.createDataFrame([(0, "§§", []), (1, "BER", ["Flughafen BER"]), (2, "a-b", ["$"]), (3, "12", [])], "ord long, normalform string, aliases array<string>")
    rows = spark.createDataFrame([("Nach §§ 12 und BER.",), ("a-b kostet 5 $",), ("§ a b Berlin",), ("",), (None,)], "text string")
    want = {r["text"]: r["actors"] or [] for r in entities.match_entities(rows, ents).collect()}
    monkeypatch.setattr(entities, "PATTERNS", 0)
    assert {r["text"]: r["actors"] or [] for r in entities.match_entities(rows, ents).collect()} == want and want["Nach §§ 12 und BER."] == ["§§", "BER", "12"]


def test_close_pairs_against_all(spark, monkeypatch):
    import numpy as np

    g = np.random.default_rng(5)
    centres = g.normal(size=(6, 12))
    v = np.concatenate([c + 0.2 * g.normal(size=(60, 12)) for c in centres])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"k{i:03d}", x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist())], "k string, v array<double>").repartition(5)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 25)
    s = v @ v.T
    for low, high in ((0.9, 2.0), (0.3, 0.6), (-1.0, -0.2)):
        want = {(f"k{i:03d}", f"k{j:03d}") for i in range(len(v)) for j in range(i + 1, len(v)) if low <= s[i, j] <= high}
        assert {(r["a"], r["b"]) for r in vectors.close_pairs(df, "k", low, high).collect()} == want


def test_stores(spark, tmp_path):
    import sqlite3

    import numpy as np

    from annalist.sources import stores

    np.save(tmp_path / "a.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert sorted((r["row"], r["v"]) for r in stores.read_npy(spark, str(tmp_path)).collect()) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("CREATE TABLE documents (doc_id INTEGER, source TEXT)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [(1, "a"), (2, None)])
    db.commit()
    db.close()
    got = stores.read_sqlite(spark, str(tmp_path), "documents", "doc_id long, source string, title string").collect()
    assert sorted((r["doc_id"], r["source"], r["title"]) for r in got) == [(1, "a", None), (2, None, None)]
    assert stores.read_sqlite(spark, str(tmp_path), "other", "x long").count() == 0
    both = stores.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, s string"), "k")
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_staging_needs_a_shared_folder_on_a_cluster(spark, tmp_path):
    from types import SimpleNamespace

    from annalist.plans import staging

    bare = SimpleNamespace(get=lambda *a: None)
    far = SimpleNamespace(conf=bare, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: bare))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(far)
    held = staging.stage(spark.range(3), "three")
    assert held.count() == 3
    staging.discard(held)
    with pytest.raises(Exception, match="(?i)not.*exist|not.*found"):
        spark.read.parquet(held._staged_at)


def test_labels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_LABELS", 2)
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "k int, v array<double>")
    labels = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "ord int, c array<double>")
    with pytest.raises(ValueError, match="labels"):
        vectors.ranked_labels(rows, labels, "k")
    assert vectors.ranked_labels(rows, labels.limit(2), "k").count() == 1


def test_k_vote(spark):
    assert tuple(vectors.k_vote(spark.createDataFrame([(5,), (3,), (3,)], "k int")).first()) == (3, 2)
    assert tuple(vectors.k_vote(spark.createDataFrame([(5,), (3,), (4,)], "k int")).first()) == (3, 1)


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    para = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = para("Heading1", "Notizen") + para("Normal", "Meyer: Buch 12") + para("Heading1", "Quelle A") + para("Normal", "Ein Satz 45") + para("Normal", " ")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    got = docx.notes_segments(docx.read_docx(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r["level"], r["type"], r["source"], r["page"], r["text"], r["segment_id"]) for r in got] == [
        (1, "meta", None, None, "Notizen", "s0001"), (2, "bibliography", None, 12, "Meyer: Buch", "s0002"), (3, "content", "Quelle A", 45, "Ein Satz", "s0003"),
    ]


def test_vault_once(spark, tmp_path):
    vault = tmp_path / "vault" / "sub"
    os.makedirs(vault)
    (vault / "Eins.md").write_text('---\ntitle: "T"\nsource: http://x\nauthor:\n  - "[[Ann|A]]"\npublished: 2024-11-07\n---\n\nText eins', encoding="utf-8")
    run = lambda: ingest_vault(spark, str(tmp_path / "vault"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert run() == 1
    (vault / "Zwei.md").write_text("nur Text", encoding="utf-8")
    assert run() == 1 and run() == 0
    os.makedirs(tmp_path / "vault" / "moved")
    os.rename(vault / "Zwei.md", tmp_path / "vault" / "moved" / "Zwei.md")
    assert run() == 0  # known by its base name
    got = {r["source"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["T"]["date"] == "2024-11-07" and got["T"]["author"] == "Ann" and got["T"]["text"] == "Text eins" and got["Zwei"]["text"] == "nur Text"
    assert articles.read_vault(spark, str(tmp_path / "vault")).count() == 2
