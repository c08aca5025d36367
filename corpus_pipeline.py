"""A training-data pipeline over ``documents``: language, exact copies, near copies, benchmark leaks, mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.decontaminate import benchmark_overlap
from annalist.llm.exact_dedup import first_of_copies
from annalist.llm.filters import maybe_in
from annalist.llm.langid import identify, train
from annalist.llm.mixing import mix_sources
from annalist.llm.simhash import near_components, text_digest
from annalist.plans.staging import stage
from annalist.plans.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A prediction that is ambiguous and scores less is a rejection.
LEAST_SCORE = 0.5
#: Near copies: Jaccard similarity of five-word shingles; candidates by 512-bit fingerprints.
SIMILARITY, SHINGLE, FINGERPRINT_WORDS = 0.8, 5, 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter or with an undecided prediction go.

    Null and empty texts have no letter; a null ``lang`` is not learned from; repeated rows share their fate; without any
    language to learn every document goes; an empty table stays empty.
    """
    model = train(docs)
    told = identify(docs.select(*COLUMNS), model)
    return told.filter((F.col("lang_pred") != "und") & ~(F.col("ambiguous") & (F.col("score") < LEAST_SCORE))).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space: the longest, then that with the smallest id (null last).

    Null counts as an empty text; of repeated rows one stays; an empty table stays empty.
    """
    return first_of_copies(docs.select(*COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id (null last), of each group of near copies.

    Null and empty texts are one group; of different texts under the id that stays one stays; rows equal in id and text stay
    or go together; an empty table stays empty. Only rows that may go, by a filter of bounded size, are shuffled.
    """
    comps = near_components(docs, SIMILARITY, shingle=SHINGLE, words=FINGERPRINT_WORDS)
    gone = stage(comps.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "neargone")
    rows = docs.select(*COLUMNS)
    digest = text_digest(F.col("text"))
    asked, maybe = maybe_in(rows, F.xxhash64("doc_id", digest), gone.select(F.xxhash64("_id", "_digest").alias("h")), gone.count())
    again = asked.filter(maybe).select(*COLUMNS).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (digest == F.col("_digest")), "left_anti")
    return asked.filter(~maybe).select(*COLUMNS).unionByName(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window.

    Null and empty texts have none and stay; repeated rows share their fate; an empty table or benchmark takes nothing out.
    """
    bench = table(spark, sf_dir, "benchmark")
    carry = tuple(c for c in COLUMNS if c != "doc_id")
    return benchmark_overlap(docs.select(*COLUMNS), bench, keep=carry).filter("n_hit = 0").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that enter the mix, with the number of times they do.

    Null and empty texts have no words and never enter; a null source is a source; repeated rows count one by one; an empty
    table gives an empty mix.
    """
    return mix_sources(docs).filter("copies > 0")


STAGES = [("language ID", language), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies), ("benchmark decontamination", decontaminate), ("mixing", mix)]
#: No SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
