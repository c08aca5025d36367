"""Registered queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.centroids import centroid_clusters
from annalist.llm.chat import perspectives
from annalist.llm.decontaminate import benchmark_overlap, items_digest
from annalist.llm.exact_dedup import exact_dedup
from annalist.llm.html_text import extract_main_text
from annalist.llm.langid import held_out, identify, train
from annalist.llm.mixing import mix_sources
from annalist.llm.packing import pack_documents
from annalist.llm.periodic import periodic_runs
from annalist.llm.simhash import simhash_components
from annalist.llm.substring_dedup import substring_dedup
from annalist.llm.suffix_dedup import suffix_dedup
from annalist.llm.warc import read_archives, write_archives
from annalist.plans.staging import new_path
from annalist.plans.tables import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side; the mask as text."""
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return perspectives(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash_components(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 20 words that occur earlier, in all documents."""
    return substring_dedup(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~out).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier, in all documents."""
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters of all vectors after five rounds; the final centroid as a digest of its numbers."""
    found = centroid_clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``; in a tenth of the documents, by the CRC of the id, the words from the ``a``-th on repeat with period ``p``."""
    words = F.when((F.expr("_h % 10") == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h")).withColumn("_w", words)
    rows = rows.withColumns({"_n": F.size("_w").cast("long"), "_g": F.expr("_h div 10")}).withColumn("_a", F.expr("CASE WHEN _n > 0 THEN _g % _n END"))
    rows = rows.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    planted = F.expr("array_join(transform(sequence(0L, _n - 1), i -> element_at(_w, CAST(1 + CASE WHEN i < _a THEN i ELSE _a + (i - _a) % _p END AS INT))), ' ')")
    return rows.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, some of them planted."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.expr("""array_sort(runs, (x, y) -> CASE
        WHEN CAST(x.length AS DECIMAL(18,0)) * y.period <> CAST(y.length AS DECIMAL(18,0)) * x.period THEN CASE WHEN CAST(x.length AS DECIMAL(18,0)) * y.period > CAST(y.length AS DECIMAL(18,0)) * x.period THEN -1 ELSE 1 END
        WHEN x.start <> y.start THEN CASE WHEN x.start < y.start THEN -1 ELSE 1 END
        WHEN x.period < y.period THEN -1 WHEN x.period > y.period THEN 1 ELSE 0 END)""")
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    top = found.withColumn("_b", F.get(best, F.lit(0)))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), F.col("_b.length").alias("length"), F.col("_b.period").alias("period"),
        F.expr("1000 * _b.length div _b.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; the ids of a piece as a checksum."""
    import public_tokenizers

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_exact_dedup, op3_chat_perspectives, op4_simhash, op5_substring_dedup, op6_decontamination, op7_warc, op8_language_id, op9_suffix_dedup, op10_html_extraction,
        op11_centroid_clusters, op12_periodic_runs, op13_packing,
    )
}

#: One round of exact Lloyd steps in SQL: vectors of ``q`` to centroids of ``c{i}``, and their floored means.
_ROUND = """a{i} AS MATERIALIZED (SELECT vec_id, v, arg_min(cid, d) AS cid, min(d)[1] AS d FROM
        (SELECT vec_id, v, cid, [list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, cid] AS d FROM q CROSS JOIN c{i}) GROUP BY vec_id, v),
    m{i} AS (SELECT cid, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, 65) t(j) GROUP BY cid, j),
    c{k} AS MATERIALIZED (SELECT cid, coalesce(f, c) AS c FROM c{i} LEFT JOIN (SELECT cid, list((s - ((s % n) + n) % n) // n ORDER BY j) AS f FROM m{i} GROUP BY cid) USING (cid))"""

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS rn
              FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r""",
    "op3_chat_perspectives": r"""
        WITH m AS (SELECT conv_id, turn, replace(replace(regexp_replace(coalesce(role, 'unknown'), '[\r\n]+', ' ', 'g'), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS role,
                          replace(replace(coalesce(text, ''), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') AS text FROM conversations),
        t AS (SELECT *, CAST(0 AS BIGINT) AS part FROM m),
        s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
        x AS (SELECT t.conv_id, t.part, s.speaker, t.turn, t.role, t.text, t.role = s.speaker AS own,
                     '<|im_start|>' || CASE WHEN t.role = s.speaker THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || chr(10) AS h,
                     t.text || '<|im_end|>' || chr(10) AS b
              FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
        y AS (SELECT *, sum(length(h) + length(b)) OVER (PARTITION BY conv_id, part, speaker ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM x)
        SELECT conv_id, part, speaker, count(*) AS n_turns, string_agg(h || b, '' ORDER BY turn NULLS LAST, role, text) AS text,
               coalesce(string_agg((stop - length(b))::VARCHAR || '-' || (stop - 1)::VARCHAR, ',' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE own), '') AS mask
        FROM y GROUP BY conv_id, part, speaker""",
    "op7_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT page_id, html, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id) AS first_id FROM p),
        b AS (SELECT *, unhex(sha1(html)) AS d, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS abc FROM f),
        bits AS (SELECT *, array_to_string(list_transform(range(20), lambda i: lpad(bin(('0x' || substr(sha1(html), 1 + 2 * i, 2))::INTEGER), 8, '0')), '') AS s FROM b)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr(abc, 1 + list_sum(list_transform(range(5), lambda j: substr(s, 5 * i + j + 1, 1)::INTEGER * (16 >> j)))::INTEGER, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM bits""",
    "op5_substring_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(len(w) - 19)) AS i, w FROM t WHERE len(w) >= 20),
        h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i + 1:i + 20], ' ') ORDER BY doc_id, i) > 1 AS again FROM s),
        c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM h WHERE again) GROUP BY doc_id),
        k AS (SELECT t.doc_id, w, coalesce(gone, []) AS gone FROM t LEFT JOIN c USING (doc_id)),
        u AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM t),
        kept AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.p) AS x FROM u LEFT JOIN (SELECT doc_id, unnest(gone) AS p FROM c) g ON g.doc_id = u.doc_id AND g.p = u.p WHERE g.p IS NULL GROUP BY u.doc_id)
        SELECT k.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM k LEFT JOIN kept ON kept.doc_id = k.doc_id""",
    "op6_decontamination": r"""
        WITH lo AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lo),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
        p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
    "op9_suffix_dedup": r"""
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS i FROM t WHERE len(h) >= 200)),
        a AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1),
        g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM a),
        r AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
        p AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM r),
        k AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(e - s) AS BIGINT) AS n_removed, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) || substr(any_value(h), 2 * max(e) + 1) AS l FROM p JOIN t USING (doc_id) GROUP BY doc_id)
        SELECT t.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(l, h))) AS kept_sha256 FROM t LEFT JOIN k ON k.doc_id = t.doc_id""",
    "op11_centroid_clusters": f"""
        WITH q AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cid, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM q ORDER BY h, v LIMIT 40)),
    {", ".join(_ROUND.format(i=i, k=i + 1) for i in range(6))}
        SELECT vec_id, CAST(cid AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cid) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a5 JOIN c5 USING (cid)""",
    # on these pages the main text is the article element; SQL takes just that
    "op10_html_extraction": r"""
        WITH b AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?p>|</?h1>') AS parts FROM pages),
        u AS (SELECT page_id, url, list_filter(list_transform(parts, lambda p: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(replace(p, '<br>', ' '), '<[^>]*>', '', 'g'),
            '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda p: p <> '') AS parts FROM b)
        SELECT page_id, url, array_to_string(parts, chr(10) || chr(10)) AS text, length(array_to_string(parts, chr(10) || chr(10))) AS n_chars FROM u""",
}
