"""Joins, aggregates and the fact table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.catalog.corpus import CATEGORIES, ENTRIES_SQL, Catalog, actor_rows, dated, segments, with_dated, with_segments
from annalist.functions import text as T
from annalist.operators import entities as E
from annalist.operators import facts
from annalist.plans.numbering import numbered
from annalist.plans.tables import table

C = Catalog()
SID = "doc_id || '-' || pos"

# Fixed inputs: a dictionary of words that the documents hold.
ENTITIES = [(0, "The", "Konzept", ["and", "AND"]), (1, "en", "Ort", ["Ble"]), (2, "von", "Person", []), (3, "Les", "Organisation", ["des", "la"]), (4, "qui", "Person", ["que", "The"])]
_ROWS = "ord long, normalform string, typ string, aliases array<string>"
ENT_SQL = "ent(ord, normalform, typ, aliases) AS (VALUES (0, 'The', 'Konzept', ['and', 'AND']), (1, 'en', 'Ort', ['Ble']), (2, 'von', 'Person', CAST([] AS VARCHAR[])), (3, 'Les', 'Organisation', ['des', 'la']), (4, 'qui', 'Person', ['que', 'The']))"


def entity_list(spark):
    """A fixed entity list."""
    return spark.createDataFrame(ENTITIES, _ROWS)


#: Entities of the documents: words with a capital, as many as there are; those of one language are the known ones, of another the proposed, and
#: the long ones of a third the rejected. Each has its lower-case form and its first five letters as aliases.
_TOKENS = "SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents"
_NAMED = """SELECT row_number() OVER (ORDER BY w) - 1 AS ord, w AS normalform, ['Person', 'Ort', 'Organisation', 'Konzept'][1 + length(w) % 4] AS typ, [lower(w), substr(w, 1, 5)] AS aliases FROM (SELECT DISTINCT w FROM tok WHERE {where} AND regexp_matches(w, '^[A-Z][a-z]{{3,}}$'))"""
_KNOWN, _ASKED, _REFUSED = "lang = 'en'", "lang = 'de'", "lang = 'fr' AND length(w) > 8"
TOKEN_SQL = f"WITH tok AS ({_TOKENS}), known AS ({_NAMED.format(where=_KNOWN)}), asked AS ({_NAMED.format(where=_ASKED)}), refused AS ({_NAMED.format(where=_REFUSED)})"


def named_tokens(spark, d, where):
    """Entities that the documents name."""
    w = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("w"))
    w = w.filter(F.expr(where) & F.col("w").rlike("^[A-Z][a-z]{3,}$")).select("w").distinct()
    kinds = F.array(*[F.lit(x) for x in ("Person", "Ort", "Organisation", "Konzept")])
    typ = F.element_at(kinds, (1 + F.length("w") % 4).cast("int"))
    rows = numbered(w, ["w"], "_at")
    return rows.select((F.col("_at") - 1).alias("ord"), F.col("w").alias("normalform"), typ.alias("typ"), F.array(F.lower("w"), F.substring("w", 1, 5)).alias("aliases"))


def identified(df):
    """With ``segment_id``."""
    return df.withColumn("segment_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string")))


def classified(df):
    """Classification of three in four segments, with actors."""
    c = identified(df).filter("(doc_id + pos) % 4 > 0")
    return c.select("segment_id", "category", "confidence", F.expr("CASE WHEN pos % 2 = 0 THEN array(source, lang) ELSE array() END").cast("array<string>").alias("actors"))


_CLS = f"cls AS (SELECT {SID} AS segment_id, category, confidence, CASE WHEN pos % 2 = 0 THEN [source, lang] ELSE CAST([] AS VARCHAR[]) END AS actors FROM dat WHERE (doc_id + pos) % 4 > 0)"
ENTRY_SQL = rf"""{_CLS}, raw AS (SELECT row_number() OVER (ORDER BY doc_id, pos) AS id, {SID} AS doc_anchor, time_from AS year, coalesce(nullif(date, ''), CAST(time_from AS VARCHAR)) AS date_raw, dat.*, cls.category AS event_type, cls.confidence AS conf, coalesce(cls.actors, []) AS actors
    FROM dat LEFT JOIN cls ON cls.segment_id = {SID}),
    entries AS (SELECT id, doc_anchor, year, date_raw, CASE WHEN regexp_matches(date_raw, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN date_raw WHEN regexp_matches(date_raw, '^\d{{4}}$') THEN date_raw || '-01-01' WHEN time_from IS NOT NULL THEN CAST(time_from AS VARCHAR) || '-01-01' END AS date_js,
    CASE WHEN precision IN ('exact', 'heading', 'manual') THEN 'exact' WHEN precision IS NOT NULL THEN 'year' ELSE 'none' END AS date_precision, text, event_type, CASE WHEN conf = 'medium' THEN 'med' ELSE conf END AS confidence,
    source AS source_name, nullif(date, '') AS source_date, 'http://' || (pos % 3) AS url, substr(text, 1, 1) IN ('”', '„', '‚', '“', '''', '"') AS is_quote, actors FROM raw)"""


def entries(spark, d):
    """Fact rows over all lines."""
    rows = identified(dated(spark, d)).withColumn("url", F.concat(F.lit("http://"), (F.col("pos") % 3).cast("string")))
    return facts.build_entries(rows, classified(rows))


FIELDS = "id, doc_anchor, year, date_raw, date_js, date_precision, text, event_type, confidence, source_name, source_date, url, is_quote"


@C.add(with_dated("").rstrip() + f", {ENTRY_SQL} SELECT {FIELDS}, array_to_string(actors, '|') AS actors FROM entries")
def j_entries(spark, d):
    return entries(spark, d).withColumn("actors", F.array_join("actors", "|")).drop("causal_theme")


@C.add(with_dated("").rstrip() + f", {_CLS} SELECT doc_id, pos, cls.category, cls.confidence FROM dat LEFT JOIN cls ON cls.segment_id = {SID}")
def j_preview(spark, d):
    rows = identified(dated(spark, d)).drop("category", "confidence")
    return rows.join(classified(dated(spark, d)), "segment_id", "left").select("doc_id", "pos", "category", "confidence")


@C.add(with_segments("SELECT doc_id, pos FROM seg WHERE type = 'content' AND (category IS NULL AND confidence IS NULL OR (doc_id + pos) % 4 = 0)"))
def j_resume_anti(spark, d):
    s = identified(segments(spark, d)).filter("type = 'content'")
    done = classified(segments(spark, d)).filter("category IS NOT NULL OR confidence IS NOT NULL")
    return s.join(done, "segment_id", "left_anti").select("doc_id", "pos")


@C.add("SELECT page_id FROM pages WHERE page_id % 3 <> 0")
def j_checkpoint_anti(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("/new/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"))
    done = p.filter("page_id % 3 = 0").select(F.concat(F.lit("/old/x/"), F.element_at(F.split("path", "/"), -1)).alias("path"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    return p.join(done.select(base("path").alias("b")), base(p["path"]) == F.col("b"), "left_anti").select("page_id")


@C.add("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def j_stage_resume(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id").distinct().join(e.filter("event_type = 'purchase'").select("user_id"), "user_id", "left_anti")


@C.add("SELECT n_name FROM nation WHERE lower(n_name) NOT IN ('france', 'japan')")
def j_rejected(spark, d):
    ents = table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("normalform"))
    gone = spark.createDataFrame([(" France",), ("JAPAN",)], "normalform string")
    return E.drop_rejected(ents, gone).select(F.col("normalform").alias("n_name"))


@C.add(f"""WITH {ENT_SQL}, a AS (SELECT ord, normalform, lower(unnest(list_prepend(normalform, aliases))) AS alias FROM ent), m AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)),
    last AS (SELECT alias, arg_max(normalform, ord) AS nf FROM a GROUP BY alias) SELECT coalesce(nf, w) AS normalform, count(*) AS n FROM m LEFT JOIN last ON lower(trim(w)) = alias GROUP BY 1""")
def j_alias_norm(spark, d):
    m = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("mention"))
    return E.normalise_mentions(m, entity_list(spark)).groupBy("normalform").agg(F.count("*").alias("n"))


@C.add(f"WITH {ENT_SQL}, a AS (SELECT ord, typ, lower(unnest(list_prepend(normalform, aliases))) AS alias FROM ent) SELECT n_name, coalesce(arg_min(typ, ord), 'Org') AS typ FROM nation LEFT JOIN a ON alias = lower(substr(n_name, 1, 2)) GROUP BY n_name")
def j_alias_typ(spark, d):
    t = E.alias_rows(entity_list(spark)).groupBy("alias").agg(F.min_by("typ", "ord").alias("typ"))
    n = table(spark, d, "nation")
    return n.join(t, F.lower(F.substring("n_name", 1, 2)) == t["alias"], "left").select("n_name", F.coalesce("typ", F.lit("Org")).alias("typ"))


_MATCH = ", ".join(
    rf"CASE WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({alt})([^\p{{L}}\p{{N}}_]|$)') THEN '{nf}' END"
    for nf, alt in (("The", "the|and"), ("en", "en|ble"), ("von", "von"), ("Les", "les|des|la"), ("qui", "qui|que|the"))
)


@C.add(with_segments(f"SELECT doc_id, pos, array_to_string(list_filter([{_MATCH}], lambda x: x IS NOT NULL), '|') AS actors FROM seg WHERE type = 'content'"))
def j_dict_match(spark, d):
    s = segments(spark, d).filter("type = 'content'").select("doc_id", "pos", "text")
    return E.match_entities(s, entity_list(spark)).select("doc_id", "pos", F.array_join("actors", "|").alias("actors"))


@C.add(f"""{TOKEN_SQL}, a AS (SELECT DISTINCT ord, lower(unnest(list_prepend(normalform, aliases))) AS alias FROM asked), k AS (SELECT DISTINCT ord, lower(unnest(list_prepend(normalform, aliases))) AS alias FROM known)
    SELECT a.ord AS p_ord, k.ord AS k_ord, count(*) AS shared FROM a JOIN k USING (alias) GROUP BY ALL""")
def j_alias_overlap(spark, d):
    return E.overlapping(named_tokens(spark, d, _ASKED), named_tokens(spark, d, _KNOWN))


# the aliases hold the name itself, so a proposal's names count as known ones whether it is new or confirmed
@C.add(f"""{TOKEN_SQL}, n AS (SELECT ord, normalform, lower(unnest(list_prepend(normalform, aliases))) AS alias FROM asked), no AS (SELECT DISTINCT lower(unnest(list_prepend(normalform, aliases))) AS alias FROM refused),
    yes AS (SELECT DISTINCT lower(unnest(list_prepend(normalform, aliases))) AS alias FROM known), s AS (SELECT DISTINCT ord FROM n WHERE alias IN (FROM no)),
    f AS (SELECT alias, min(ord) AS first FROM n WHERE ord NOT IN (FROM s) GROUP BY alias)
    SELECT ord, normalform, CASE WHEN ord IN (FROM s) THEN 'skipped' WHEN bool_or(alias IN (FROM yes) OR first < ord) THEN 'confirmed' ELSE 'new' END AS status FROM n LEFT JOIN f USING (alias) GROUP BY ord, normalform""")
def a_merge_proposal(spark, d):
    return E.merge_proposal(*(named_tokens(spark, d, x) for x in (_ASKED, _KNOWN, _REFUSED))).select("ord", "normalform", "status")


@C.add(with_segments("""t AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents),
    ent AS (SELECT row_number() OVER (ORDER BY w) - 1 AS ord, w FROM (SELECT DISTINCT w FROM t WHERE lang = 'en' AND regexp_matches(w, '^[A-Z][a-z]{3,}$'))),
    nm AS (SELECT ord, w, lower(w) AS name FROM ent UNION SELECT ord, w, lower(substr(w, 1, 5)) FROM ent),
    hit AS (SELECT DISTINCT doc_id, pos, ord, w FROM (SELECT DISTINCT doc_id, pos, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+')) AS name FROM seg) JOIN nm USING (name))
    SELECT seg.doc_id, seg.pos, coalesce(string_agg(w, '|' ORDER BY ord), '') AS actors FROM seg LEFT JOIN hit ON hit.doc_id = seg.doc_id AND hit.pos = seg.pos GROUP BY seg.doc_id, seg.pos""").replace(") t AS (", "), t AS (", 1))
def j_dict_match_many(spark, d):
    """All segments against every name of the documents, by one automaton."""
    s = segments(spark, d).select("doc_id", "pos", "text")
    return E.match_entities(s, named_tokens(spark, d, _KNOWN)).select("doc_id", "pos", F.array_join("actors", "|").alias("actors"))


_INITCAP = "array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"


@C.add(f"SELECT 'p' AS project, n_nationkey AS ord, {_INITCAP} AS normalform, 'Ort' AS typ, 0.9 AS score, 'llm_full' AS source, {_INITCAP} || '|' || n_name || 'n' AS aliases FROM nation")
def a_merge_entities(spark, d):
    a = table(spark, d, "nation").select(F.lit("p").alias("project"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("normalform"), F.lit("Ort").alias("typ"), F.lit(0.5).alias("score"), F.lit("spacy").alias("source"), F.array(F.initcap("n_name")).alias("aliases"))
    b = a.withColumns({"ord": F.col("ord") + 100, "normalform": F.initcap("normalform"), "score": F.lit(0.9), "source": F.lit("llm_full"), "aliases": F.array(F.concat("normalform", F.lit("n")))})
    return E.merge_entities(a.unionByName(b)).withColumn("aliases", F.array_join("aliases", "|"))


@C.add("SELECT lower(n_name) AS k, min(n_nationkey) AS ord, 0.9 AS score FROM nation GROUP BY 1")
def a_dedup_ci(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("normalform"), F.lit("Ort").alias("typ"), F.lit(0.5).alias("score"), F.array("n_name").alias("aliases"))
    b = a.withColumns({"ord": F.col("ord") + 100, "normalform": F.initcap("normalform"), "score": F.lit(0.9)})
    return E.dedup_names(a.unionByName(b)).select(F.lower("normalform").alias("k"), "ord", "score")


_ACT = f"x AS ({ENTRIES_SQL})"


@C.add(f"WITH {_ACT} SELECT id FROM x GROUP BY id HAVING bool_or(actor = 'p17') AND bool_or(actor = 'p29')")
def j_edge_shared(spark, d):
    e = actor_rows(spark, d).filter(F.col("actor").isin("p17", "p29")).groupBy("id").agg(F.collect_set("actor").alias("s"))
    return e.filter(F.size("s") == 2).select("id")


@C.add(f"WITH {_ACT}, a AS (SELECT DISTINCT actor FROM x WHERE id % 500 = 1) SELECT p.id, p.actor AS a, q.actor AS b FROM x p JOIN x q ON p.id = q.id AND p.i < q.i WHERE p.actor IN (FROM a) AND q.actor IN (FROM a)")
def j_answer_subgraph(spark, d):
    x = actor_rows(spark, d)
    wanted = x.filter("id % 500 = 1").select("actor").distinct()
    kept = x.join(wanted, "actor", "left_semi")
    p, q = kept.alias("p"), kept.alias("q")
    return p.join(q, (F.col("p.id") == F.col("q.id")) & (F.col("p.i") < F.col("q.i"))).select("p.id", F.col("p.actor").alias("a"), F.col("q.actor").alias("b"))


@C.add("""WITH a AS (SELECT DISTINCT lower(source) AS k, lang FROM documents WHERE doc_id % 3 = 0), b AS (SELECT DISTINCT lower(source) AS k, lang FROM documents WHERE doc_id % 7 = 0)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.lang, b.lang) AS lang, CASE WHEN a.k IS NULL THEN 'only B' WHEN b.k IS NULL THEN 'only A' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k AND a.lang = b.lang""")
def j_compare(spark, d):
    t = table(spark, d, "documents")
    one = lambda m: t.filter(F.col("doc_id") % m == 0).select(F.lower("source").alias("k"), "lang").distinct()
    a, b = one(3).withColumn("a", F.lit(True)), one(7).withColumn("b", F.lit(True))
    side = F.when(F.col("a").isNull(), "only B").when(F.col("b").isNull(), "only A").otherwise("both")
    return a.join(b, ["k", "lang"], "full").select("k", "lang", side.alias("side"))


@C.add("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def j_latest_doc(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@C.add(with_segments("SELECT type, count(*) AS n FROM seg GROUP BY type"))
def a_type_counts(spark, d):
    return segments(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@C.add(with_segments(rf"SELECT count(*) FILTER (WHERE len(list_filter([{_MATCH}], lambda x: x IS NOT NULL)) > 0) AS matched, count(*) AS content FROM seg WHERE type = 'content'"))
def a_match_cov(spark, d):
    s = segments(spark, d).filter("type = 'content'").select("text")
    return E.match_entities(s, entity_list(spark)).agg(F.count_if(F.size("actors") > 0).alias("matched"), F.count("*").alias("content"))


@C.add(with_segments("SELECT t.ord, t.name, count(s.category) AS n FROM (VALUES (0, 'Politik'), (1, 'Außenpolitik'), (2, 'Kultur'), (3, 'Wirtschaft'), (4, 'Anderes')) t(ord, name) LEFT JOIN seg s ON s.category = t.name GROUP BY ALL"))
def a_class_stats(spark, d):
    tax = spark.createDataFrame(list(enumerate(CATEGORIES)), "ord int, name string")
    n = segments(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    return tax.join(n, tax["name"] == n["category"], "left").select("ord", "name", F.coalesce("n", F.lit(0)).alias("n"))


@C.add(with_segments("""SELECT CASE WHEN pct < 2 THEN 'rare' ELSE 'catch-all' END AS kind, category, pct FROM (SELECT coalesce(category, 'Ohne Kategorie') AS category, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM seg GROUP BY 1)
    WHERE pct < 2 OR ((contains(lower(category), 'anderes') OR contains(lower(category), 'ohne kategorie')) AND pct > 15) UNION ALL SELECT 'low', NULL, pct FROM (SELECT count(*) FILTER (WHERE confidence = 'low') * 100.0 / count(*) AS pct FROM seg) WHERE pct > 15"""))
def a_quality(spark, d):
    return facts.quality_report(segments(spark, d))


@C.add(with_dated("").rstrip() + f", {ENTRY_SQL} SELECT unnest(['year', 'date_raw', 'event_type', 'confidence', 'source_date']) AS field, unnest([count(*) - count(year), count(*) - count(date_raw), count(*) - count(event_type), count(*) - count(confidence), count(*) - count(source_date)]) AS missing FROM entries")
def a_entry_validate(spark, d):
    return facts.validate_entries(entries(spark, d)).filter(F.col("field").isin("year", "date_raw", "event_type", "confidence", "source_date"))


@C.add(with_dated("").rstrip() + f""", {ENTRY_SQL}, g AS (SELECT source_name, url, min(id) AS first_id, string_agg(text, chr(10) || chr(10) ORDER BY id) FILTER (WHERE text <> '') AS text, list_sort(list_distinct(flatten(list(actors ORDER BY id)))) AS actors FROM entries GROUP BY ALL),
    m AS (SELECT source_name, url, event_type, row_number() OVER (PARTITION BY source_name, url ORDER BY count(*) DESC, min(id)) AS rn FROM entries WHERE event_type <> '' GROUP BY source_name, url, event_type)
    SELECT row_number() OVER (ORDER BY first_id) AS id, g.source_name, g.url, md5(text) AS text_md5, m.event_type, array_to_string(actors, '|') AS actors FROM g LEFT JOIN m ON m.rn = 1 AND m.source_name = g.source_name AND m.url = g.url""")
def a_group_article(spark, d):
    g = facts.group_by_article(entries(spark, d))
    return g.select("id", "source_name", "url", F.md5("text").alias("text_md5"), "event_type", F.array_join(F.array_sort("actors"), "|").alias("actors"))


@C.add(with_dated("SELECT min(time_from) AS year_min, max(time_from) AS year_max FROM dat WHERE type = 'content' AND time_from <> 0"))
def a_year_range(spark, d):
    return dated(spark, d).filter("type = 'content' AND time_from <> 0").agg(F.min("time_from").alias("year_min"), F.max("time_from").alias("year_max"))


@C.add(with_dated("SELECT p.name AS precision, count(d.precision) AS n FROM (VALUES ('exact'), ('heading'), ('event'), ('decade'), ('interpolated'), ('manual')) p(name) LEFT JOIN dat d ON d.precision = p.name GROUP BY 1"))
def a_precision_pills(spark, d):
    names = spark.createDataFrame([(p,) for p in ("exact", "heading", "event", "decade", "interpolated", "manual")], "name string")
    n = dated(spark, d).groupBy("precision").agg(F.count("*").alias("n"))
    return names.join(n, names["name"] == n["precision"], "left").select(F.col("name").alias("precision"), F.coalesce("n", F.lit(0)).alias("n"))


@C.add(with_segments("SELECT coalesce(category, 'Ohne Kategorie') AS category, count(*) AS n FROM seg GROUP BY 1"))
def a_category_counts(spark, d):
    return facts.category_counts(segments(spark, d)).select("category", "n")


@C.add(f"WITH {_ACT} SELECT actor, count(*) AS n, count(DISTINCT id) AS entries, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM x GROUP BY actor")
def a_actor_entries(spark, d):
    """The index from actors to their entries, one for each mention, and their counts."""
    e = facts.actor_index(actor_rows(spark, d))
    return e.select("actor", "n", "entries", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@C.add(with_dated("").rstrip() + f", {ENTRY_SQL} SELECT actor, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS ids FROM (SELECT id, unnest(actors) AS actor FROM entries) GROUP BY actor HAVING count(*) >= 3")
def a_summary_candidates(spark, d):
    s = facts.summary_candidates(entries(spark, d))
    return s.select("actor", "n", F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).alias("ids"))


@C.add(f"{TOKEN_SQL} SELECT typ, count(*) AS n FROM known GROUP BY typ")
def a_entity_types(spark, d):
    return named_tokens(spark, d, _KNOWN).groupBy("typ").agg(F.count("*").alias("n"))


@C.add("SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM documents) WHERE w <> '' GROUP BY w HAVING count(*) >= 5")
def a_token_freq(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("w <> ''")
    return w.groupBy("w").agg(F.count("*").alias("n")).filter("n >= 5")


@C.add("SELECT count(*) FILTER (WHERE lower(w) = w) AS lower_case, count(*) FILTER (WHERE length(w) < 4) AS short, count(*) FILTER (WHERE regexp_matches(w, '(ing|ung|tion)$')) AS verbal FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents)")
def a_noise(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct()
    return w.agg(F.count_if(F.lower("w") == F.col("w")).alias("lower_case"), F.count_if(F.length("w") < 4).alias("short"), F.count_if(F.col("w").rlike("(ing|ung|tion)$")).alias("verbal"))


@C.add("SELECT lower(source) AS k, count(DISTINCT lang) AS types FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def a_type_conflict(spark, d):
    return table(spark, d, "documents").groupBy(F.lower("source").alias("k")).agg(F.countDistinct("lang").alias("types")).filter("types > 1")


@C.add("WITH w AS (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS w FROM documents), k AS (SELECT lower(unnest(['The', 'and', 'Xyzzy', 'von'])) AS k) SELECT avg(CASE WHEN k IN (FROM w) THEN 1.0 ELSE 0.0 END) AS recall FROM k")
def a_recall(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).select(F.lower("w").alias("k")).distinct().withColumn("hit", F.lit(1.0))
    known = spark.createDataFrame([("the",), ("and",), ("xyzzy",), ("von",)], "k string")
    return known.join(w, "k", "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


@C.add("SELECT old, new, n, row_number() OVER (PARTITION BY old ORDER BY n DESC, new) AS rank FROM (SELECT quality AS old, toxic AS new, count(*) AS n FROM labels GROUP BY ALL) QUALIFY rank <= 2")
def a_confusion(spark, d):
    return facts.confusion(table(spark, d, "labels"), "quality", "toxic").filter("rank <= 2").select("old", "new", "n", "rank")


@C.add("""WITH n AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL), top AS (SELECT a, arg_max(b, (n, -ascii(b))) AS b FROM n GROUP BY a)
    SELECT n.a, top.b AS dominant, sum(n) AS total, coalesce(sum(n) FILTER (WHERE n.b <> top.b), 0) AS moved FROM n JOIN top ON n.a = top.a GROUP BY ALL""")
def a_crosstab_match(spark, d):
    x = facts.confusion(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
    top = F.max(F.when(F.col("rank") == 1, F.col("new")))
    return x.groupBy(F.col("old").alias("a")).agg(top.alias("dominant"), F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("rank") > 1, F.col("n"))), F.lit(0)).alias("moved"))


@C.add("SELECT p_brand, avg(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') THEN 1.0 ELSE 0.0 END) AS recall FROM part WHERE p_partkey % 5 = 0 GROUP BY p_brand")
def a_holdout_recall(spark, d):
    held = table(spark, d, "part").filter("p_partkey % 5 = 0").select("p_partkey", "p_brand")
    found = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(1.0))
    return held.join(found, "p_partkey", "left").groupBy("p_brand").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


@C.add("SELECT lang, sum(tokens) AS tokens, round(sum(tokens) * CASE lang WHEN 'en' THEN 0.25 ELSE 1.25 END / 1000000, 6) AS cost FROM (SELECT lang, length(text) // 4 AS tokens FROM documents) GROUP BY lang")
def a_cost(spark, d):
    price = spark.createDataFrame([("en", 0.25), ("de", 1.25), ("fr", 1.25), ("es", 1.25)], "lang string, price double")
    t = table(spark, d, "documents").groupBy("lang").agg(F.sum(F.floor(F.length("text") / 4)).alias("tokens"))
    return t.join(price, "lang").select("lang", "tokens", F.round(F.col("tokens") * F.col("price") / 1_000_000, 6).alias("cost"))


@C.add("SELECT c_custkey, count(o_orderkey) AS n, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' OR c_custkey = 7 GROUP BY c_custkey")
def a_project_counts(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING' OR c_custkey = 7").select("c_custkey")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    return c.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "latest")


@C.add(with_segments("SELECT doc_id, pos, CASE WHEN doc_id = 3 AND pos = 1 THEN 'Neu' ELSE category END AS category FROM seg"))
def a_row_update(spark, d):
    change = spark.createDataFrame([("3-1", "Neu")], "segment_id string, new_category string")
    return facts.update_category(identified(segments(spark, d)), change).select("doc_id", "pos", "category")


@C.add("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type")
def a_score_dist(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


@C.add("""SELECT round(avg(v) FILTER (WHERE a), 6) AS mean_a, round(stddev_pop(v) FILTER (WHERE a), 6) AS sd_a, count(*) FILTER (WHERE a) AS n_a,
    round((avg(v) FILTER (WHERE a) - avg(v) FILTER (WHERE NOT a)) / sqrt((var_pop(v) FILTER (WHERE a) + var_pop(v) FILTER (WHERE NOT a)) / 2), 6) AS cohens_d FROM (SELECT value AS v, event_type = 'click' AS a FROM events)""")
def a_describe(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "click", F.col("value")).alias("a"), F.when(F.col("event_type") != "click", F.col("value")).alias("b"))
    gap = (F.avg("a") - F.avg("b")) / F.sqrt((F.var_pop("a") + F.var_pop("b")) / 2)
    return e.agg(F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.stddev_pop("a"), 6).alias("sd_a"), F.count("a").alias("n_a"), F.round(gap, 6).alias("cohens_d"))


@C.add("SELECT source, min(doc_id) AS first_seen FROM documents GROUP BY source")
def a_list_sources(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first_seen")).orderBy("first_seen")


@C.add(f"{TOKEN_SQL}, a AS (SELECT ord, normalform, typ, unnest(list_prepend(normalform, aliases)) AS alias, generate_subscripts(list_prepend(normalform, aliases), 1) - 1 AS i FROM known) SELECT ord, i, alias, normalform, typ FROM a QUALIFY row_number() OVER (PARTITION BY ord, lower(alias) ORDER BY i) = 1")
def snk_alias_csv(spark, d):
    return E.alias_csv(named_tokens(spark, d, _KNOWN))


@C.add("SELECT n_nationkey, lower(n_name) AS alias, n_name || ', land, x' AS normalform, 'Ort' AS typ FROM nation")
def src_alias_csv(spark, d):
    line = F.concat(F.lower("n_name"), F.lit(","), "n_name", F.lit(", land, x,Ort"))
    return table(spark, d, "nation").select("n_nationkey", E.parse_alias_line(line).alias("x")).select("n_nationkey", "x.*")
