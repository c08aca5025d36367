"""Graph, time series, windows, sorting and search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.catalog.corpus import ENTRIES_SQL, Catalog, actor_rows, dated, segments, with_dated, with_segments
from annalist.operators import graph as G
from annalist.operators import search
from annalist.plans.tables import table

C = Catalog()
X = f"WITH x AS ({ENTRIES_SQL})"
EDGES = f"""{X}, pr AS (SELECT least(p.actor, q.actor) AS a, greatest(p.actor, q.actor) AS b, p.event_type FROM x p JOIN x q ON p.id = q.id AND p.i < q.i),
    e AS (SELECT * FROM (SELECT a, b, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY a, b) AS t FROM pr GROUP BY a, b, event_type) WHERE t >= 2)"""


def edge_rows(spark, d):
    """Edges of parts that share orders."""
    return G.edges(actor_rows(spark, d))


@C.add(f"{X} SELECT CASE WHEN s <= 50 THEN 'day' WHEN s <= 350 THEN 'week' WHEN s <= 1500 THEN 'month' ELSE 'year' END AS unit FROM (SELECT max(day) - min(day) AS s FROM x)")
def g_auto_bin(spark, d):
    return actor_rows(spark, d).agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(G.bin_unit(F.col("lo"), F.col("hi")).alias("unit"))


@C.add("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS event_type FROM orders), ext AS (SELECT min(day) AS lo, max(day) AS hi FROM o),
    b AS (SELECT CAST(unnest(generate_series(date_trunc('year', lo), hi::TIMESTAMP, INTERVAL 1 YEAR)) AS DATE) AS b, lo FROM ext), t AS (SELECT DISTINCT event_type FROM o),
    c AS (SELECT CAST(date_trunc('year', day) AS DATE) AS b, event_type, count(*) AS n FROM o GROUP BY ALL) SELECT greatest(lo, b.b) AS bin, t.event_type, coalesce(n, 0) AS n FROM b CROSS JOIN t LEFT JOIN c ON c.b = b.b AND c.event_type = t.event_type""")
def g_bin_series(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("event_type"))
    return G.series(o, "year")


@C.add("""WITH o AS (SELECT CAST(ts AS DATE) AS day, event_type FROM events), ext AS (SELECT min(day) AS lo, max(day) AS hi FROM o), b AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('week', lo + 1) AS DATE) - 1, hi::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS b, lo FROM ext), t AS (SELECT DISTINCT event_type FROM o),
    c AS (SELECT CAST(date_trunc('week', day + 1) AS DATE) - 1 AS b, event_type, count(*) AS n FROM o GROUP BY ALL) SELECT greatest(lo, b.b) AS bin, t.event_type, coalesce(n, 0) AS n FROM b CROSS JOIN t LEFT JOIN c ON c.b = b.b AND c.event_type = t.event_type""")
def g_bin_series_weeks(spark, d):
    return G.series(table(spark, d, "events").select(F.col("ts").cast("date").alias("day"), "event_type"), "week")


@C.add("SELECT year(o_orderdate) AS year, " + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY 1")
def g_heat(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return o.groupBy("year").pivot("o_orderpriority", names).agg(F.count(F.lit(1))).na.fill(0)


@C.add(f"{X} SELECT actor, count(*) AS n FROM x GROUP BY actor")
def g_nodes(spark, d):
    return actor_rows(spark, d).groupBy("actor").agg(F.count("*").alias("n"))


@C.add(f"{EDGES} SELECT a, b, event_type, n FROM e")
def g_edges(spark, d):
    return edge_rows(spark, d)


@C.add(f"{EDGES} SELECT actor, count(DISTINCT other) AS links FROM (SELECT a AS actor, b AS other FROM e UNION ALL SELECT b, a FROM e) GROUP BY actor")
def g_neighbors(spark, d):
    return G.neighbours(edge_rows(spark, d))


@C.add(f"{EDGES} SELECT a, b, sum(n) AS total, count(DISTINCT event_type) AS types FROM e GROUP BY ALL")
def g_pair_totals(spark, d):
    return G.pair_totals(edge_rows(spark, d))


@C.add(f"{EDGES} SELECT a, b, event_type, row_number() OVER (PARTITION BY a, b ORDER BY event_type) AS i, count(*) OVER (PARTITION BY a, b) AS of FROM e")
def w_edge_index(spark, d):
    w = Window.partitionBy("a", "b")
    return edge_rows(spark, d).select("a", "b", "event_type", F.row_number().over(w.orderBy("event_type")).alias("i"), F.count("*").over(w).alias("of"))


@C.add(f"""{EDGES}, f AS (SELECT a, b FROM e WHERE n >= 2), k1 AS (SELECT v FROM (SELECT unnest([a, b]) AS v FROM f) GROUP BY v HAVING count(*) >= 2),
    f1 AS (SELECT * FROM f WHERE a IN (FROM k1) AND b IN (FROM k1)), k2 AS (SELECT v FROM (SELECT unnest([a, b]) AS v FROM f1) GROUP BY v HAVING count(*) >= 2), f2 AS (SELECT * FROM f1 WHERE a IN (FROM k2) AND b IN (FROM k2)),
    k3 AS (SELECT v FROM (SELECT unnest([a, b]) AS v FROM f2) GROUP BY v HAVING count(*) >= 2), f3 AS (SELECT * FROM f2 WHERE a IN (FROM k3) AND b IN (FROM k3)), k4 AS (SELECT v FROM (SELECT unnest([a, b]) AS v FROM f3) GROUP BY v HAVING count(*) >= 2) SELECT v AS actor FROM k4""")
def g_kcore(spark, d):
    e = edge_rows(spark, d).filter("n >= 2")
    nodes = e.select(F.col("a").alias("actor")).unionAll(e.select(F.col("b").alias("actor"))).distinct()
    return G.k_core(e, nodes)


@C.add(f"{EDGES}, s AS MATERIALIZED (SELECT DISTINCT unnest([a, b]) AS v FROM e WHERE a = 'p17' OR b = 'p17') SELECT a, b, event_type, n FROM e JOIN s x ON e.a = x.v JOIN s y ON e.b = y.v WHERE event_type = '1-URGENT'")
def g_ego(spark, d):
    return G.ego(edge_rows(spark, d), "p17").filter("event_type = '1-URGENT'")


@C.add(f"{EDGES} SELECT a, b, event_type, n FROM e WHERE a = 'p17' AND b = 'p29'")
def g_pair_focus(spark, d):
    return edge_rows(spark, d).filter("a = 'p17' AND b = 'p29'")


_RUNS = """SELECT {by}, min(d) AS start, max(d) AS stop, count(*) AS days FROM (SELECT *, sum(nw) OVER (PARTITION BY {by} ORDER BY d) AS run FROM
    (SELECT {by}, d, CASE WHEN d - lag(d) OVER (PARTITION BY {by} ORDER BY d) <= {gap} THEN 0 ELSE 1 END AS nw FROM (SELECT DISTINCT {by}, CAST({col} AS DATE) AS d FROM {t}))) GROUP BY {by}, run"""


@C.add(_RUNS.format(by="o_custkey", gap=366, col="o_orderdate", t="orders"))
def w_runs(spark, d):
    return G.runs(table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")), "o_custkey", "day", G.RUN_GAP["year"])


@C.add(_RUNS.format(by="user_id", gap=2, col="ts", t="events"))
def g_entity_highlight(spark, d):
    return G.runs(table(spark, d, "events").withColumn("day", F.col("ts").cast("date")), "user_id", "day", G.RUN_GAP["day"])


@C.add("SELECT event_type, CAST(max(ts) AS DATE) AS bin FROM events GROUP BY event_type")
def w_last_nonzero(spark, d):
    return G.last_nonzero(G.series(table(spark, d, "events").select(F.col("ts").cast("date").alias("day"), "event_type"), "day"))


@C.add(with_segments("SELECT doc_id, pos, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM seg"))
def w_ffill_heading(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return segments(spark, d).select("doc_id", "pos", F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(w).alias("heading"))


@C.add(with_dated("""SELECT doc_id, pos, last_value(time_from IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
    first_value(time_from IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM dat"""))
def w_prev_next(spark, d):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return dated(spark, d).select(
        "doc_id", "pos", F.last("time_from", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"), F.first("time_from", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next")
    )


@C.add(with_segments("SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM seg WHERE type = 'content'"))
def w_row_number(spark, d):
    return segments(spark, d).filter("type = 'content'").select("doc_id", "pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("n"))


@C.add(f"{X} SELECT actor, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min((id, i))) AS rank FROM x GROUP BY actor QUALIFY rank <= 50")
def w_rank_nodes(spark, d):
    return G.ranked_nodes(actor_rows(spark, d), 50)


@C.add("SELECT event_type, event_id, hi, lo FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS lo FROM events) WHERE hi <= 3 OR lo <= 3")
def w_bottomk(spark, d):
    w = Window.partitionBy("event_type")
    e = table(spark, d, "events").select("event_type", "event_id", F.row_number().over(w.orderBy(F.desc("value"), "event_id")).alias("hi"), F.row_number().over(w.orderBy("value", "event_id")).alias("lo"))
    return e.filter("hi <= 3 OR lo <= 3")


@C.add("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn, first_id) AS pick FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn,
    min(event_id) OVER (PARTITION BY user_id, event_type) AS first_id FROM events)) WHERE pick <= 30""")
def w_round_robin(spark, d):
    w = Window.partitionBy("user_id", "event_type")
    e = table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w.orderBy("event_id")).alias("rn"), F.min("event_id").over(w).alias("first_id"))
    return e.withColumn("pick", F.row_number().over(Window.partitionBy("user_id").orderBy("rn", "first_id"))).filter("pick <= 30").select("user_id", "event_id")


@C.add("SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id) LIMIT 50")
def w_sample(spark, d):
    t = table(spark, d, "documents").select("doc_id")
    return t.orderBy(F.md5(F.concat(F.lit("42-"), F.col("doc_id").cast("string")))).limit(50)


@C.add("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7-' || doc_id)) <= greatest(1, floor(count(*) OVER (PARTITION BY lang) * 0.8)) AS train FROM documents")
def w_stratified_split(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang")
    w = Window.partitionBy("lang")
    r = t.withColumns({"rn": F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("7-"), F.col("doc_id").cast("string"))))), "n": F.count("*").over(w)})
    return r.select("doc_id", "lang", (F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.8))).alias("train"))


@C.add("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS batch FROM documents")
def w_batch(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.floor((F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1) / 5).alias("batch"))


@C.add(with_dated("SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY time_from IS NULL, time_from, coalesce(time_to, time_from, 0), pos) AS place FROM dat"))
def o_chrono(spark, d):
    w = Window.partitionBy("doc_id").orderBy(F.col("time_from").isNull(), "time_from", F.coalesce("time_to", "time_from", F.lit(0)), "pos")
    return dated(spark, d).select("doc_id", "pos", F.row_number().over(w).alias("place"))


@C.add(with_dated("SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(time_from, 0), pos) AS place FROM dat"))
def o_year_id(spark, d):
    return dated(spark, d).select("doc_id", "pos", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("time_from", F.lit(0)), "pos")).alias("place"))


WORDS = ("nicht", "with", "with", "para", "dans")
_SCORE = " + ".join(f"contains(lower(text), '{w}')::INT" for w in WORDS)


@C.add(f"SELECT doc_id, {_SCORE} AS score FROM documents WHERE {_SCORE} > 0 ORDER BY score DESC, doc_id LIMIT 20")
def o_search_topk(spark, d):
    return search.top_entries(table(spark, d, "documents"), WORDS, 20, "doc_id").select("doc_id", "score")


@C.add(f"SELECT doc_id FROM documents WHERE {_SCORE} > 0")
def o_search_or(spark, d):
    return search.any_keyword(table(spark, d, "documents"), WORDS).select("doc_id")


@C.add(with_segments(f"SELECT source, doc_id, pos, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id, pos) AS rank FROM (SELECT *, {_SCORE} AS score FROM seg) WHERE score > 0 QUALIFY rank <= 3"))
def o_kw_segments(spark, d):
    s = segments(spark, d).withColumn("score", search.score(F.col("text"), WORDS)).filter("score > 0")
    w = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id", "pos")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("source", "doc_id", "pos", "score", "rank")


_indexes: dict[tuple[str, str], search.TextIndex] = {}


def text_index(spark, d):
    """The index over all segments; written once in a session and folder, and used by every query that asks for it."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _indexes:
        _indexes[at] = search.build_index(segments(spark, d).select("source", "doc_id", "pos", "text"), ["doc_id", "pos"])
    return _indexes[at]


RARE = ("nicht im jahr", "balkan", "titel (19", "ß", "zzz")
_RARE = " + ".join(f"contains(lower(text), '{w}')::INT" for w in RARE)


@C.add(with_segments(f"SELECT doc_id, pos, {_RARE} AS score FROM seg WHERE {_RARE} > 0 ORDER BY score DESC, doc_id, pos LIMIT 20"))
def ix_search_topk(spark, d):
    return text_index(spark, d).matching(RARE).orderBy(F.desc("score"), "doc_id", "pos").limit(20).select("doc_id", "pos", "score")


@C.add(with_segments(f"SELECT doc_id, pos FROM seg WHERE {_RARE} > 0"))
def ix_search_or(spark, d):
    return text_index(spark, d).matching(RARE).select("doc_id", "pos")


@C.add(with_segments(f"SELECT source, doc_id, pos, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id, pos) AS rank FROM (SELECT *, {_SCORE} AS score FROM seg) WHERE score > 0 QUALIFY rank <= 3"))
def ix_kw_segments(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id", "pos")
    return text_index(spark, d).matching(WORDS).withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("source", "doc_id", "pos", "score", "rank")


@C.add(with_segments(f"SELECT doc_id, count(*) AS n FROM (SELECT *, {_SCORE} AS score FROM seg) WHERE score > 0 GROUP BY doc_id"))
def t_kw_count(spark, d):
    return segments(spark, d).filter(search.score(F.col("text"), WORDS) > 0).groupBy("doc_id").agg(F.count("*").alias("n"))


@C.add("SELECT source, string_agg(lang, '|' ORDER BY length(lang || source) DESC, lang) AS terms FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source")
def o_term_len(spark, d):
    t = table(spark, d, "documents").select("source", "lang").distinct()
    order = F.array_sort(F.collect_list(F.struct((-F.length("lang")).alias("n"), "lang")))
    return t.groupBy("source").agg(F.array_join(F.transform(order, lambda x: x["lang"]), "|").alias("terms"))
