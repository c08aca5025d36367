"""Vectors, tf-idf and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.catalog.corpus import VECTORS_SQL, Catalog, segments, vectors, with_segments
from annalist.operators import entities as E
from annalist.operators import tfidf
from annalist.operators import vectors as V
from annalist.operators.density import best_distance, density_sweep, mutual_reach
from annalist.plans.tables import table

C = Catalog()
D = 64
W = f"WITH vec AS ({VECTORS_SQL})"
CEN = f"""{W}, m AS (SELECT label, i, avg(v[i]) AS x FROM vec, range(1, {D + 1}) t(i) GROUP BY ALL), l AS (SELECT label, sqrt(sum(x * x)) AS len FROM m GROUP BY label),
    cen AS (SELECT m.label, list(x / greatest(len, 1e-9) ORDER BY i) AS c FROM m JOIN l USING (label) GROUP BY m.label)"""
DOT = "list_inner_product"
THETA = 0.4


@C.add(f"{W} SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(sqrt(list_inner_product(v, v)) / sqrt(list_inner_product(v, v)), 6) AS len FROM vec")
def v_normalize(spark, d):
    n = V.normalised(F.col("v"))
    return vectors(spark, d).select("vec_id", F.round(n[0], 6).alias("first"), F.round(V.norm(n), 6).alias("len"))


@C.add(f"{W} SELECT a.vec_id, round({DOT}(a.v, b.v), 6) AS sim FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1")
def v_cosine(spark, d):
    a, b = vectors(spark, d).alias("a"), vectors(spark, d).withColumn("vec_id", F.col("vec_id") - 1).alias("b")
    return a.join(b, F.col("a.vec_id") == F.col("b.vec_id")).select("a.vec_id", F.round(V.dot("a.v", "b.v"), 6).alias("sim"))


@C.add(f"{CEN} SELECT label, round(c[1], 6) AS first, round(c[{D}], 6) AS last FROM cen")
def v_centroid(spark, d):
    return V.centroids(vectors(spark, d), "label").select("label", F.round(F.col("c")[0], 6).alias("first"), F.round(F.col("c")[D - 1], 6).alias("last"))


def labels(spark, d):
    """Cluster centroids as label vectors."""
    return V.centroids(vectors(spark, d), "label").withColumnRenamed("label", "ord")


@C.add(f"{CEN} SELECT vec_id, cen.label, CASE WHEN s > 0.5 THEN 'high' WHEN s > 0.35 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT vec_id, cen.label, round({DOT}(v, c), 9) AS s FROM vec CROSS JOIN cen) cen QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cen.label) = 1")
def v_classify_cosine(spark, d):
    return V.classify(vectors(spark, d), labels(spark, d), "vec_id").select("vec_id", "label", "confidence")


@C.add(f"{CEN} SELECT label, count(*) AS n FROM (SELECT vec_id, cen.label, {DOT}(v, c) AS s FROM vec CROSS JOIN cen QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cen.label) = 1) GROUP BY label")
def v_assign(spark, d):
    return V.ranked_labels(vectors(spark, d), labels(spark, d), "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@C.add(f"{CEN} SELECT vec_id, CASE WHEN gap > 0.3 THEN 'high' WHEN gap > 0.1 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT vec_id, s - lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC) AS gap, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS rn FROM (SELECT vec_id, {DOT}(v, c) AS s FROM vec CROSS JOIN cen)) WHERE rn = 1")
def v_classify_pairs(spark, d):
    r = V.ranked_labels(vectors(spark, d), labels(spark, d), "vec_id")
    gap = F.col("score") - F.col("runner_up")
    return r.select("vec_id", F.when(gap > 0.3, "high").when(gap > 0.1, "medium").otherwise("low").alias("confidence"))


@C.add(f"{CEN} SELECT cen.label, count(*) AS n, count(*) FILTER (WHERE {DOT}(v, c) > 0.2) AS close FROM vec CROSS JOIN cen GROUP BY cen.label")
def j_cross_score(spark, d):
    return vectors(spark, d).drop("label").crossJoin(V.centroids(vectors(spark, d), "label")).groupBy("label").agg(F.count("*").alias("n"), F.count_if(V.dot("v", "c") > 0.2).alias("close"))


@C.add(f"{CEN}, s AS (SELECT vec_id, label, {DOT}(v, c) AS s FROM vec JOIN cen USING (label)) SELECT label, arg_max(vec_id, (round(s, 9), -vec_id)) AS medoid FROM s GROUP BY label")
def v_medoid(spark, d):
    return V.to_centroid(vectors(spark, d), "label").groupBy("label").agg(F.max_by("vec_id", F.struct(F.round("sim", 9), -F.col("vec_id"))).alias("medoid"))


@C.add(f"{CEN}, s AS (SELECT vec_id, label, round({DOT}(v, c), 9) AS s FROM vec JOIN cen USING (label)) SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM s QUALIFY rank <= 5")
def w_topn_cosine(spark, d):
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("sim", 9)), "vec_id"))
    return V.to_centroid(vectors(spark, d), "label").withColumn("rank", r).filter("rank <= 5").select("label", "vec_id", "rank")


@C.add(f"""{W}, m AS (SELECT label, i, avg(v[i]) AS x FROM vec, range(1, {D + 1}) t(i) GROUP BY ALL), mm AS (SELECT label, list(x ORDER BY i) AS m FROM m GROUP BY label), s AS (SELECT vec_id, label, round(list_distance(v, m), 9) AS dist FROM vec JOIN mm USING (label))
    SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rank FROM s QUALIFY rank <= 5""")
def w_topk_cluster(spark, d):
    return V.nearest_members(vectors(spark, d), "label", "vec_id", 5).select("label", "vec_id", "rank")


@C.add(f"""{CEN}, s AS (SELECT vec_id, label, round({DOT}(v, c), 9) AS s FROM vec JOIN cen USING (label)), r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS hi, row_number() OVER (PARTITION BY label ORDER BY s, vec_id) AS lo, count(*) OVER (PARTITION BY label) AS size FROM s)
    SELECT label, vec_id, hi, lo, size FROM r WHERE hi <= 5 OR lo <= 3""")
def w_topbottom_report(spark, d):
    w = Window.partitionBy("label")
    s = F.round("sim", 9)
    r = V.to_centroid(vectors(spark, d), "label").withColumns({"hi": F.row_number().over(w.orderBy(F.desc(s), "vec_id")), "lo": F.row_number().over(w.orderBy(s, "vec_id")), "size": F.count("*").over(w)})
    return r.filter("hi <= 5 OR lo <= 3").select("label", "vec_id", "hi", "lo", "size")


@C.add(f"""{CEN}, lab AS (SELECT label, v AS c FROM vec JOIN (SELECT min(vec_id) AS vec_id FROM vec GROUP BY label) USING (vec_id)), s AS (SELECT lab.label, lab.label = cen.label AS own, {DOT}(lab.c, cen.c) AS s FROM lab CROSS JOIN cen)
    SELECT label, round(max(s) FILTER (WHERE own) - max(s) FILTER (WHERE NOT own), 6) AS delta FROM s GROUP BY label""")
def v_delta(spark, d):
    lab = vectors(spark, d).groupBy("label").agg(F.min_by("v", "vec_id").alias("c"))
    return V.label_delta(lab, V.centroids(vectors(spark, d), "label"), "label").withColumn("delta", F.round("delta", 6))


@C.add(f"{W} SELECT a.label, count(DISTINCT a.vec_id) AS n, round(avg({DOT}(a.v, b.v)), 6) AS sim FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label")
def v_intra_sim(spark, d):
    return V.intra_similarity(vectors(spark, d), "label").withColumn("sim", F.round("sim", 6))


@C.add(f"{CEN}, s AS (SELECT vec_id, vec.label AS old, cen.label AS new FROM vec CROSS JOIN cen QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {DOT}(v, c) DESC, cen.label) = 1) SELECT round(avg(CASE WHEN old <> new THEN 1.0 ELSE 0.0 END), 6) AS moved FROM s")
def v_move_pct(spark, d):
    v = vectors(spark, d)
    r = V.ranked_labels(v, labels(spark, d), "vec_id").withColumnRenamed("label", "new")
    return v.join(r, "vec_id").agg(F.round(F.avg((F.col("label") != F.col("new")).cast("double")), 6).alias("moved"))


@C.add(f"{W} SELECT a.vec_id AS a, b.vec_id AS b, round({DOT}(a.v, b.v), 6) AS sim FROM vec a JOIN vec b ON a.vec_id < b.vec_id WHERE {DOT}(a.v, b.v) >= {THETA}")
def j_pair_cosine(spark, d):
    return V.close_pairs(vectors(spark, d), "vec_id", THETA).withColumn("sim", F.round("sim", 6))


@C.add(f"""WITH RECURSIVE vec AS ({VECTORS_SQL}), p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vec a JOIN vec b ON a.vec_id <> b.vec_id AND {DOT}(a.v, b.v) >= {THETA}), r(a, b) AS (SELECT vec_id, vec_id FROM vec UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
    SELECT a AS vec_id, min(b) AS component FROM r GROUP BY a""")
def v_union_find(spark, d):
    return V.similarity_components(vectors(spark, d), "vec_id", THETA)


@C.add("""SELECT n_regionkey AS component, arg_max(n_name, (len(string_split_regex(trim(n_name), '\\s+')), length(n_name), -n_nationkey)) AS normalform, max(n_nationkey * 1.0) AS score, 'Ort' AS typ FROM nation GROUP BY 1""")
def v_cluster_merge(spark, d):
    m = table(spark, d, "nation").select(F.col("n_regionkey").alias("component"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.lit("Ort").alias("typ"), (F.col("n_nationkey") * 1.0).cast("double").alias("score"))
    return V.merge_cluster_names(m).select("component", "normalform", "score", "typ")


# greedy by a fold over all pairs in order: the state is what is used up and what is chosen
@C.add(f"""{W}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, {DOT}(a.v, b.v) AS sim FROM vec a JOIN vec b ON a.vec_id < b.vec_id WHERE {DOT}(a.v, b.v) BETWEEN 0.35 AND 0.5),
    l AS (SELECT list({{'used': [a, b], 'got': [{{'a': a, 'b': b, 'sim': sim}}]}} ORDER BY sim DESC, a, b) AS x FROM p),
    f AS (SELECT list_reduce(x, lambda s, e: CASE WHEN list_has_any(s.used, e.used) THEN s ELSE {{'used': list_concat(s.used, e.used), 'got': list_concat(s.got, e.got)}} END) AS r FROM l WHERE x IS NOT NULL)
    SELECT g.a AS a, g.b AS b, round(g.sim, 6) AS sim FROM (SELECT unnest(r.got) AS g FROM f)""")
def o_greedy_match(spark, d):
    return E.greedy_pairs(V.close_pairs(vectors(spark, d), "vec_id", 0.35, 0.5)).select("a", "b", F.round("sim", 6).alias("sim"))


@C.add(f"""{W}, c AS (SELECT vec_id AS ord, v AS c FROM vec WHERE vec_id < 7), s AS (SELECT vec_id, ord, round(list_distance(v, c), 9) AS dist FROM vec CROSS JOIN c) SELECT vec_id, arg_min(ord, (dist, ord)) AS cluster FROM s GROUP BY vec_id""")
def v_kmeans_step(spark, d):
    c = vectors(spark, d).filter("vec_id < 7").select(F.col("vec_id").alias("ord"), F.col("v").alias("c"))
    return V.lloyd_step(vectors(spark, d), c, "vec_id")


@C.add()
def v_kmeans(spark, d):
    return V.kmeans(vectors(spark, d), "vec_id", 7)


@C.add()
def v_elbow(spark, d):
    return V.elbow(V.inertia_curve(vectors(spark, d), range(3, 13)))


_SILHOUETTE = """{w}, p AS (SELECT a.vec_id, a.label AS own, b.label, avg({dist}) FILTER (WHERE a.vec_id <> b.vec_id) AS d FROM vec a CROSS JOIN vec b GROUP BY ALL),
    s AS (SELECT vec_id, max(d) FILTER (WHERE own = label) AS a, min(d) FILTER (WHERE own <> label) AS b FROM p GROUP BY vec_id) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s"""


@C.add(_SILHOUETTE.format(w=W, dist="list_distance(a.v, b.v)"))
def v_silhouette(spark, d):
    return V.silhouette(vectors(spark, d), "label", "vec_id").select(F.round("silhouette", 6).alias("silhouette"))


@C.add(_SILHOUETTE.format(w=W, dist="list_cosine_distance(a.v, b.v)"))
def v_silhouette_cosine(spark, d):
    return V.silhouette(vectors(spark, d), "label", "vec_id", "cosine").select(F.round("silhouette", 6).alias("silhouette"))


@C.add()
def v_silhouette_guard(spark, d):
    """The number of clusters at which the cosine silhouette stops gaining."""
    v = vectors(spark, d).drop("label")
    scored = [(k, V.silhouette(v.join(V.kmeans(v, "vec_id", k), "vec_id"), "cluster", "vec_id", "cosine").first()["silhouette"]) for k in range(2, 7)]
    return V.guarded_elbow(spark.createDataFrame(scored, "k int, score double"))


EPS = (0.1, 0.15, 0.2, 0.25, 0.5, 0.6, 0.7)
_SWEEP = f"""WITH RECURSIVE vec AS ({VECTORS_SQL}), eps AS (SELECT unnest([{', '.join(f'{e}::DOUBLE' for e in EPS)}]) AS eps), p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_distance(a.v, b.v) AS dist FROM vec a JOIN vec b ON a.vec_id <> b.vec_id AND {DOT}(a.v, b.v) >= 0.29),
    r(eps, a, b) AS (SELECT eps, vec_id, vec_id FROM vec CROSS JOIN eps UNION SELECT r.eps, r.a, p.b FROM r JOIN p ON r.b = p.a AND p.dist <= r.eps),
    c AS (SELECT eps, a, CASE WHEN count(*) > 1 THEN min(b) END AS cluster FROM r GROUP BY eps, a), s AS (SELECT eps, count(DISTINCT cluster) AS clusters, avg((cluster IS NULL)::INT) AS noise FROM c GROUP BY eps),
    best AS (SELECT arg_max(eps, (clusters, -noise, -eps)) FILTER (WHERE clusters >= 2 AND noise < 0.3) AS best FROM s)"""


def _swept(spark, d):
    """DBSCAN of the vectors at each of the distances, from one tree."""
    unit = vectors(spark, d).select("vec_id", V.normalised(F.col("v")).alias("v"))
    return density_sweep(mutual_reach(unit, "vec_id", 1), [(2 * e) ** 0.5 for e in EPS], 2)


@C.add(f"{_SWEEP} SELECT c.a AS vec_id, c.eps, c.cluster, best IS NOT NULL AND c.eps = best AS chosen FROM c CROSS JOIN best")
def v_dbscan(spark, d):
    """Clusters of the vectors at several cosine distances, and whether the distance is the one that is chosen by noise and number of clusters."""
    sweep = _swept(spark, d)
    chosen = best_distance(sweep).select(F.col("eps").alias("_eps"), "chosen")
    rows = sweep.join(F.broadcast(chosen), F.col("eps") == F.col("_eps"))
    return rows.select(F.col("k").alias("vec_id"), F.round(F.col("eps") * F.col("eps") / 2, 6).alias("eps"), "cluster", "chosen")


@C.add(f"""{_SWEEP}
    SELECT eps, clusters, round(noise, 6) AS noise, best IS NOT NULL AND eps = best AS chosen FROM s CROSS JOIN best""")
def v_dbscan_sweep(spark, d):
    """Clusters and noise at several cosine distances, from one tree, and the distance that is chosen."""
    return best_distance(_swept(spark, d)).select(F.round(F.col("eps") * F.col("eps") / 2, 6).alias("eps"), "clusters", F.round("noise", 6).alias("noise"), "chosen")


@C.add(f"{W} SELECT vec_id, round(v[3] / n, 6) AS x FROM (SELECT vec_id, v, sqrt(v[3] * v[3] + v[11] * v[11] + v[50] * v[50]) AS n FROM vec)")
def v_subspace(spark, d):
    return vectors(spark, d).select("vec_id", F.round(V.subspace(F.col("v"), [2, 10, 49])[0], 6).alias("x"))


@C.add(f"{CEN}, a AS (SELECT list_transform(range(1, {D + 1}), lambda i: x.c[i] - y.c[i]) AS ax FROM cen x, cen y WHERE x.label = 0 AND y.label = 1) SELECT label, round(quantile_cont({DOT}(v, ax), 0.5), 6) AS median FROM vec, a GROUP BY label")
def v_axis_projection(spark, d):
    c = V.centroids(vectors(spark, d), "label")
    axis = c.agg(F.max_by("c", F.col("label") == 0).alias("x"), F.max_by("c", F.col("label") == 1).alias("y")).select(F.zip_with("x", "y", lambda a, b: a - b).alias("ax"))
    return vectors(spark, d).crossJoin(axis).groupBy("label").agg(F.round(F.percentile(V.dot("v", "ax"), 0.5), 6).alias("median"))


@C.add(f"{CEN}, s AS (SELECT vec_id, cen.label, round({DOT}(v, c), 9) AS s FROM vec JOIN cen ON vec.label <> cen.label) SELECT vec_id, label FROM s WHERE s >= 0.25 QUALIFY row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) <= 30")
def v_type_centres(spark, d):
    v, c = vectors(spark, d).alias("v"), V.centroids(vectors(spark, d), "label").alias("c")
    s = v.crossJoin(c).filter("v.label <> c.label").select("vec_id", "c.label", F.round(V.dot("v.v", "c.c"), 9).alias("s")).filter("s >= 0.25")
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "vec_id"))).filter("rn <= 30").select("vec_id", "label")


@C.add(f"{W}, t AS (SELECT label, i, sum(v[i]) AS x, count(*) AS n FROM vec, range(1, {D + 1}) t(i) GROUP BY ALL) SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x) / (any_value(a.n) * any_value(b.n)), 6) AS sim FROM t a JOIN t b ON a.i = b.i AND a.label < b.label GROUP BY ALL")
def v_pair_stats(spark, d):
    m = V.means(vectors(spark, d), ["label"])  # the mean over pairs of rows is the product of the means
    a, b = m.alias("a"), m.alias("b")
    return a.join(b, F.col("a.label") < F.col("b.label")).select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.round(V.dot("a.v", "b.v"), 6).alias("sim"))


@C.add(f"""{W}, n AS (SELECT vec_id, label, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM vec WINDOW w AS (PARTITION BY label ORDER BY vec_id)), s AS (SELECT vec_id, v, list_transform(range(1, {D + 1}), lambda i: v[i] + coalesce(p[i], 0) + coalesce(q[i], 0)) AS t FROM n)
    SELECT vec_id, round(CASE WHEN vec_id % 3 = 0 THEN t[5] / sqrt({DOT}(t, t)) ELSE v[5] END, 6) AS x FROM s""")
def w_neighbor_mean(spark, d):
    r = V.neighbour_mean(vectors(spark, d), "label", "vec_id", F.col("vec_id") % 3 == 0)
    return r.select("vec_id", F.round(F.col("v")[4], 6).alias("x"))


_TOK = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-zäöüß]{3,}$'))"
_TFIDF = f"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
    d AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM t GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT @most), w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN d USING (term), n),
    u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w), s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang)"""


@C.add(_TFIDF.replace("@most", "8000") + " SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY round(sum(w) / any_value(size), 9) DESC, term) AS rank FROM u JOIN documents USING (doc_id) JOIN s USING (lang) GROUP BY lang, term QUALIFY rank <= 8")
def t_tfidf_cluster(spark, d):
    return tfidf.cluster_keywords(table(spark, d, "documents"), "doc_id", "lang", tfidf.words_of(F.col("text"))).select("lang", "term", "rank")


@C.add(_TFIDF.replace(">= 2", ">= 1").replace("@most", "500") + " SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY round(sum(w) / any_value(size), 9) DESC, term) AS rank FROM u JOIN documents USING (doc_id) JOIN s USING (lang) GROUP BY lang, term QUALIFY rank <= 5")
def t_tfidf_small(spark, d):
    return tfidf.cluster_keywords(table(spark, d, "documents"), "doc_id", "lang", tfidf.words_of(F.col("text")), top=5, min_df=1, max_features=500).select("lang", "term", "rank")


@C.add(_TFIDF.replace(">= 2", ">= 2 AND count(*) <= 0.6 * (SELECT count(*) FROM documents)").replace("@most", "8000") + " SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY round(max(w), 9) DESC, term) AS rank FROM u JOIN documents USING (doc_id) GROUP BY lang, term QUALIFY rank <= 50")
def t_tfidf_max(spark, d):
    return tfidf.cluster_keywords(table(spark, d, "documents"), "doc_id", "lang", tfidf.words_of(F.col("text")), top=50, how="max", max_df=0.6).select("lang", "term", "rank")


@C.add("SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS w FROM benchmark) WHERE length(w) >= 3 AND w NOT IN ('the', 'and', 'that')")
def t_stop_filter(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).distinct()
    return w.filter((F.length("w") >= 3) & ~F.col("w").isin("the", "and", "that"))


@C.add(with_segments("SELECT row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, 'd' || doc_id || '-' || pos AS anchor FROM seg WHERE lang IN ('de', 'fr')"))
def u_union_docs(spark, d):
    s = segments(spark, d).withColumn("anchor", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), F.col("pos").cast("string")))
    both = s.filter("lang = 'de'").drop("date").unionByName(s.filter("lang = 'fr'"), allowMissingColumns=True)
    return both.select(F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("n"), "anchor")


@C.add("SELECT n_nationkey, n_name || '|' || lower(n_name) AS names FROM nation")
def u_union_names(spark, d):
    from annalist.functions.text import names_of

    a = F.array(F.lower("n_name"), F.lit(" "), "n_name", F.concat(F.lit(" "), F.lower("n_name")))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(names_of(F.col("n_name"), a), "|").alias("names"))


@C.add("SELECT lower(w) AS k, arg_min(w, doc_id * 100000 + i) AS w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM documents) GROUP BY 1")
def u_dedupe_kw(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    return w.groupBy(F.lower("w").alias("k")).agg(F.min_by("w", F.col("doc_id") * 100000 + F.col("i")).alias("w"))


@C.add("SELECT w, CASE WHEN a AND b THEN 'stayed' WHEN a THEN 'gone' ELSE 'new' END AS side FROM (SELECT w, bool_or(doc_id % 2 = 0) AS a, bool_or(doc_id % 2 = 1) AS b FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w)")
def u_intersect_except(spark, d):
    even = F.col("doc_id") % 2 == 0
    w = table(spark, d, "documents").select(even.alias("even"), F.explode(F.split("text", " ")).alias("w"))
    sides = w.groupBy("w").agg(F.bool_or("even").alias("a"), F.bool_or(~F.col("even")).alias("b"))
    return sides.select("w", F.when(F.col("a") & F.col("b"), "stayed").when(F.col("a"), "gone").otherwise("new").alias("side"))


@C.add("SELECT n_nationkey, lower(n_name) || '|x' AS aliases FROM nation")
def u_all_aliases(spark, d):
    from annalist.functions.text import all_aliases

    return table(spark, d, "nation").select("n_nationkey", F.array_join(all_aliases(F.col("n_name"), F.array(F.lit(""), F.lit("X"), F.lower("n_name"))), "|").alias("aliases"))


@C.add("""WITH s AS (SELECT source, list_sort(list_distinct(list(lower(substr(text, 1, 4))))) AS f FROM documents GROUP BY source)
    SELECT a.source AS a, b.source AS b, round(len(list_intersect(a.f, b.f)) * 1.0 / len(list_distinct(list_concat(a.f, b.f))), 6) AS jaccard FROM s a JOIN s b ON a.source < b.source""")
def u_jaccard(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.collect_set(F.lower(F.substring("text", 1, 4))).alias("f"))
    a, b = s.alias("a"), s.alias("b")
    j = F.size(F.array_intersect("a.f", "b.f")) / F.size(F.array_union("a.f", "b.f"))
    return a.join(b, F.col("a.source") < F.col("b.source")).select(F.col("a.source").alias("a"), F.col("b.source").alias("b"), F.round(j, 6).alias("jaccard"))


@C.add("SELECT DISTINCT unnest(list_prepend(lower(p_name), string_split(lower(p_name), ' '))) AS token FROM part")
def u_pool_tokens(spark, d):
    return table(spark, d, "part").select(F.explode(F.concat(F.array(F.lower("p_name")), F.split(F.lower("p_name"), " "))).alias("token")).distinct()
