"""Tf-idf keywords per cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.plans.staging import stage

def words_of(text: Column, least: int = 3) -> Column:
    """Lower-case words of letters only; a word that holds anything else is left out whole."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.filter(parts, lambda w: w.rlike(rf"^[a-zäöüß]{{{least},}}$"))


def weights(rows: DataFrame, key: str, words: Column, min_df: int = 2, max_features: int = 8000, max_df: float = 1.0, sublinear: bool = True) -> DataFrame:
    """Unit tf-idf weights: ``key``, ``term``, ``w``.

    The weight is (1 + ln tf, or tf) times ln((1 + n) / (1 + df)) + 1; terms outside the document frequency limits go, and of
    the others the ``max_features`` most frequent stay (ties by term).
    """
    n = rows.select(key).distinct().count()
    tf = stage(rows.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")), "tf")  # texts are cut once
    terms = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    terms = terms.orderBy(F.desc("cf"), "term").limit(max_features).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(terms, "term").withColumn("w", (1 + F.log("tf") if sublinear else F.col("tf").cast("double")) * F.col("idf"))
    lens = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_len"))
    return raw.join(lens, key).select(key, "term", (F.col("w") / F.col("_len")).alias("w"))


def top_terms(scored: DataFrame, by: str, top: int = 8) -> DataFrame:
    """The ``top`` terms per cluster by ``score``; ties by term: with ``rank``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top)


def cluster_keywords(rows: DataFrame, key: str, by: str, words: Column, top: int = 8, stop: Sequence[str] = (), how: str = "mean", **limits: float) -> DataFrame:
    """The ``top`` terms per cluster by mean (over all its rows) or largest weight; ties by term: ``term``, ``score``, ``rank``."""
    w = weights(rows, key, words, **limits).filter(~F.col("term").isin(*stop)) if stop else weights(rows, key, words, **limits)
    joined = w.join(rows.select(key, by), key)
    if how == "max":
        scored = joined.groupBy(by, "term").agg(F.max("w").alias("score"))
    else:
        size = rows.groupBy(by).agg(F.count("*").alias("_n"))
        scored = joined.groupBy(by, "term").agg(F.sum("w").alias("_w")).join(size, by).select(by, "term", (F.col("_w") / F.col("_n")).alias("score"))
    return top_terms(scored, by, top)
