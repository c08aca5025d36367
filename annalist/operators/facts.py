"""The fact table: joining classifications, grouping articles, validation and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.plans.numbering import numbered

REQUIRED = ("id", "doc_anchor", "year", "date_raw", "date_js", "date_precision", "text", "event_type", "confidence", "source_name", "source_date", "url", "is_quote", "actors", "causal_theme")
# Parts of catch-all category names.
CATCH_ALL = ("anderes", "sonstiges", "andere", "other", "misc", "quellenm", "ohne kategorie")
NO_CATEGORY = "Ohne Kategorie"
RARE, TOO_MUCH = 2.0, 15.0


def no_strings() -> Column:
    """An empty array of strings."""
    return F.array().cast("array<string>")


def build_entries(segments: DataFrame, classified: DataFrame) -> DataFrame:
    """Dated segments with their classification as fact rows of the 15 required fields, ids in document order.

    A missing classification leaves category and confidence null and actors empty; undated segments stay.
    """
    c = F.col
    cls = classified.select("segment_id", "category", "confidence", "actors")
    raw = T.date_raw(c("date_raw") if "date_raw" in segments.columns else F.lit(None).cast("string"), c("date"), c("time_from"))
    facts = {
        "doc_anchor": c("segment_id"), "year": c("time_from"), "date_raw": raw, "date_js": T.date_js(raw, c("time_from")),
        "date_precision": T.date_precision(c("precision")), "text": c("text"), "event_type": c("category"), "confidence": T.confidence_abbrev(c("confidence")), "source_name": c("source"),
        "source_date": T.empty_as_null(c("date")), "url": F.coalesce(c("url"), F.lit("")), "is_quote": T.is_quote(c("text")), "actors": F.coalesce("actors", no_strings()),
    }
    rows = segments.drop("category", "confidence", "actors").join(cls, "segment_id", "left")
    kept = rows.select(c("doc_id").alias("_doc"), c("pos").alias("_pos"), *[e.alias(n) for n, e in facts.items()])  # no other column is moved
    return numbered(kept, ["_doc", "_pos"]).select("id", *facts, no_strings().alias("causal_theme"))


def group_by_article(entries: DataFrame) -> DataFrame:
    """One entry per source name and url: the first row's fields, texts joined, the commonest category, all actors.

    Ties between categories go to the one seen first; actors keep first-seen order. ``entries`` are in the order of ``id``;
    new ids follow the first rows' order.
    """
    key = ["_s", "_u"]
    rows = entries.withColumns({"_s": F.coalesce("source_name", F.lit("")), "_u": F.coalesce("url", F.lit(""))})
    first = {c: F.min_by(c, "id").alias(c) for c in entries.columns if c not in ("id", "text", "event_type", "actors")}
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), lambda t: t.isNotNull() & (t != ""))
    actors = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("actors", no_strings()).alias("a")))), lambda x: x["a"])))
    base = rows.groupBy(*key).agg(*first.values(), F.array_join(texts, "\n\n").alias("text"), actors.alias("actors"))
    counts = rows.filter("event_type <> ''").groupBy(*key, "event_type").agg(F.count("*").alias("_n"), (-F.min("id")).alias("_f"))
    mode = counts.groupBy(*key).agg(F.max_by("event_type", F.struct("_n", "_f")).alias("event_type"))
    ids = numbered(rows.groupBy(*key).agg(F.min("id").alias("_min")), ["_min"], "_id").drop("_min")  # texts stay where they are
    return base.join(mode, key, "left").join(ids, key).drop(*key).withColumnRenamed("_id", "id")


def category_counts(rows: DataFrame, category: str = "category") -> DataFrame:
    """Rows per category, with null as ``Ohne Kategorie``, and their share in percent."""
    n = rows.groupBy(F.coalesce(T.empty_as_null(F.col(category)), F.lit(NO_CATEGORY)).alias("category")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def quality_report(rows: DataFrame) -> DataFrame:
    """Warnings, one per row (``kind``, ``category``, ``pct``): rare categories, a large catch-all, many unsure rows."""
    cats = category_counts(rows)
    catch = F.exists(F.array(*[F.lit(k) for k in CATCH_ALL]), lambda k: F.contains(F.lower("category"), k))
    rare = cats.filter(F.col("pct") < RARE).select(F.lit("rare").alias("kind"), "category", "pct")
    big = cats.filter(catch & (F.col("pct") > TOO_MUCH)).select(F.lit("catch-all").alias("kind"), "category", "pct")
    low = rows.agg((F.count_if(F.col("confidence") == "low") * 100.0 / F.count("*")).alias("pct")).filter(F.col("pct") > TOO_MUCH)
    return rare.unionByName(big).unionByName(low.select(F.lit("low").alias("kind"), F.lit(None).cast("string").alias("category"), "pct"))


def validate_entries(entries: DataFrame) -> DataFrame:
    """Missing values per required field, in one pass: rows ``field``, ``missing``."""
    def gone(f: str) -> Column:
        return F.count_if(F.col(f).isNull()).alias(f) if f in entries.columns else F.count("*").alias(f)

    one = entries.agg(*[gone(f) for f in REQUIRED])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in REQUIRED]), F.array(*[F.col(f) for f in REQUIRED]))).alias("field", "missing"))


def summary_candidates(entries: DataFrame, least: int = 3) -> DataFrame:
    """Actors with at least ``least`` mentions, their count and the entries they are in, by id."""
    a = entries.select("id", F.explode("actors").alias("actor"))
    return a.groupBy("actor").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).filter(F.col("n") >= least)


def actor_index(mentions: DataFrame) -> DataFrame:
    """The entries (``ids``) that each actor is in, in order and one for each mention (``id``, ``actor``), how many and how many different ones.

    An actor's row is as large as its mentions are.
    """
    a = mentions.groupBy("actor").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return a.select("actor", F.size("ids").cast("long").alias("n"), F.size(F.array_distinct("ids")).cast("long").alias("entries"), "ids")


def update_category(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``rows`` with the category of the segments in ``changes`` (``segment_id``, ``new_category``) replaced."""
    return rows.join(changes, "segment_id", "left").withColumn("category", F.coalesce("new_category", "category")).drop("new_category")


def confusion(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Counts per pair of labels, the pair's rank in its old label's row, and the share of it."""
    n = rows.groupBy(F.col(old).alias("old"), F.col(new).alias("new")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("old")
    return n.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "new")), "share": F.col("n") / F.sum("n").over(w)})
