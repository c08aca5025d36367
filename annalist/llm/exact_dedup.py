"""Exact deduplication by a log-structured merge index of digests, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.filters import filter_words, join_groups, maybe_in, slot
from annalist.plans.staging import new_path, stage

#: White space that does not count when texts are compared.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def sha256_hex(norm: Column) -> Column:
    """The digest that texts are grouped by."""
    return F.sha2(norm, 256)


class DigestIndex:
    """Runs of digests on shared storage, each with a filter, and their compaction.

    ``flush`` turns a batch of digests into runs: one entry per digest and run (the memtable) with the smallest identifier
    and a count, sorted by digest, as Parquet below ``path/run=<n>``; and each run's filter, a bitmap in 64-bit words, below
    ``path.filters``. ``compact`` merges the entries that the filters cannot rule out of the other runs and keeps the
    smallest identifier. ``lookup`` tells which rows of a new batch are known, asking the filters first.

    An identifier is any orderable struct; callers put what is to be preferred first.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.runs = spark, path or new_path(spark, "digests"), 0
        self.words: list[int] = []

    def flush(self, digests: DataFrame, runs: int = 1) -> None:
        """Write ``digests`` (columns ``digest``, ``ident``) as ``runs`` further sorted runs with their filters."""
        spread = F.pmod(F.xxhash64(F.lit(7), "ident"), F.lit(runs)).cast("int") + self.runs
        memtable = digests.groupBy(spread.alias("run"), "digest").agg(F.min("ident").alias("ident"), F.count("*").alias("n"))
        memtable.sortWithinPartitions("run", "digest").write.mode("append").partitionBy("run").parquet(self.path)
        self._schema = memtable.schema
        new = self.entries().filter(F.col("run") >= self.runs)
        self.words.append(filter_words(new.count() // runs, 1 << 40))
        word, bit = slot(F.xxhash64("digest"), self.words[-1])
        bits = new.groupBy("run", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
        bits.withColumn("words", F.lit(self.words[-1]).cast("long")).write.mode("append").parquet(f"{self.path}.filters")
        self.runs += runs

    def entries(self) -> DataFrame:
        """All runs."""
        return self.spark.read.schema(self._schema).parquet(self.path)

    def filters(self) -> tuple[DataFrame, int]:
        """The filters as written, folded to the length of the smallest: ``run``, ``word``, ``bits``; and that length."""
        words = min(self.words)
        held = self.spark.read.schema("run int, word long, bits long, words long").parquet(f"{self.path}.filters")
        return held.groupBy("run", F.col("word").bitwiseAND(F.lit(words - 1).cast("long")).alias("word")).agg(F.bit_or("bits").alias("bits")), words

    def compact(self) -> DataFrame:
        """One row per digest: ``digest``, smallest ``ident``, ``n`` rows."""
        if self.runs < 2:
            return self.entries().select("digest", "ident", "n")
        filters, words = self.filters()
        # bits that two or more runs have set; a word gathers at most one number per run
        both = F.aggregate(
            "w", F.struct(F.lit(0).cast("long").alias("any"), F.lit(0).cast("long").alias("two")),
            lambda s, w: F.struct(s["any"].bitwiseOR(w).alias("any"), s["two"].bitwiseOR(s["any"].bitwiseAND(w)).alias("two")),
        )["two"]
        shared = filters.groupBy("word").agg(F.collect_list("bits").alias("w")).select("word", both.alias("two")).filter("two != 0")
        word, bit = slot(F.xxhash64("digest"), words)
        marked = self.entries().withColumns({"word": word, "_bit": bit}).join(shared, "word", "left").withColumn("_hit", F.coalesce(F.getbit("two", F.col("_bit")) == 1, F.lit(False)))
        alone = marked.filter(~F.col("_hit")).select("digest", "ident", "n")
        merged = marked.filter("_hit").groupBy("digest").agg(F.min("ident").alias("ident"), F.sum("n").alias("n"))
        return alone.unionByName(merged)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """``digests`` plus ``known``: the identifier that the index has for the digest, or null."""
        filters, words = self.filters()
        any_run = filters.groupBy("word").agg(F.bit_or("bits").alias("_any"))
        word, bit = slot(F.xxhash64("digest"), words)
        asked = digests.withColumns({"word": word, "_bit": bit}).join(any_run, "word", "left").withColumn("_ask", F.coalesce(F.getbit("_any", F.col("_bit")) == 1, F.lit(False)))
        asked = asked.drop("word", "_bit", "_any")
        held = self.entries().groupBy("digest").agg(F.min("ident").alias("known"))
        hit = asked.filter("_ask").join(held, "digest", "left")
        return hit.unionByName(asked.filter(~F.col("_ask")), allowMissingColumns=True).drop("_ask")


def _n_cp(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def _row_hash(id_: Column, n_cp: Column) -> Column:
    return F.xxhash64(F.lit(11), id_, n_cp)


def _grouped(docs: DataFrame, id_col: str, text_col: str, runs: int, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, int, int]:
    """Rows (``_row``, ``doc_id``, ``n_cp``, ``digest``), their groups (``digest``, ``other``, ``ident``, ``n``), and how many
    rows there are and are hits.

    ``other`` is null, or in a digest that several texts have, the row's own text; ``ident.row`` is the row that stays.
    """
    spark, c = docs.sparkSession, F.col
    texts = docs.select(c(id_col).alias("doc_id"), _n_cp(c(text_col)).alias("n_cp"), normalised(c(text_col)).alias("norm"))
    rows = stage(texts.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "n_cp", digest(c("norm")).alias("digest"), F.lit(None).cast("string").alias("other")), "digestrows")
    ident = F.struct((-c("n_cp")).alias("neg"), c("doc_id").isNull().alias("none"), c("doc_id").alias("id"), c("_row").alias("row"))
    index = DigestIndex(spark)
    index.flush(rows.select("digest", ident.alias("ident")), runs)
    groups = stage(index.compact().withColumn("other", F.lit(None).cast("string")), "compacted")
    total, repeated = groups.agg(F.sum("n"), F.sum(F.when(c("n") > 1, c("n")))).first()
    if not repeated:
        return rows, groups, total or 0, 0
    # hits are compared by their whole texts: copies are combined before the shuffle, and a digest has one text
    many = groups.filter("n > 1").select("digest")
    asked, maybe = maybe_in(texts, _row_hash(c("doc_id"), c("n_cp")), _of_groups(rows, groups.filter("n > 1"), total).select(_row_hash(c("doc_id"), c("n_cp")).alias("h")), repeated)
    hits = asked.filter(maybe).select("doc_id", "n_cp", "norm", digest(c("norm")).alias("digest"))
    several = stage(hits.groupBy("digest", "norm").agg(F.lit(1).alias("one")).join(many, "digest", "left_semi").groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1").select("digest"), "collided")
    if several.isEmpty():
        return rows, groups, total, repeated
    hits = hits.withColumn("_row", F.monotonically_increasing_id())
    apart = stage(hits.join(several, "digest", "left_semi").select("_row", "doc_id", "n_cp", "digest", c("norm").alias("other")), "apart")
    own = apart.groupBy("digest", "other").agg(F.min(ident).alias("ident"), F.count("*").alias("n"))
    return (
        rows.join(several, "digest", "left_anti").unionByName(apart),
        stage(groups.join(several, "digest", "left_anti").unionByName(own), "groups"),
        total, repeated,
    )


def _of_groups(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Rows with their group's ``ident`` and ``n``."""
    c = F.col
    named = groups.select(c("digest").alias("_d"), c("other").alias("_o"), "ident", "n")
    return join_groups(rows, named, (c("digest") == c("_d")) & c("other").eqNullSafe(c("_o")), c("n"), total)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 4, digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """Group rows whose texts are equal without ASCII white space and name the row of each group that stays.

    Returns one row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (of the normalised text)
    and ``n_cp`` (code points of the original). The longest original stays, then the smallest id. Null text counts as
    empty; a null id sorts last; of repeated rows with the id that stays exactly one is ``kept``; an empty table gives an
    empty result; other columns are ignored.

    Rows are joined by digest, without texts. Hits, that is rows whose digest occurs more than once, are found again in the
    texts by a filter of bounded size and compared as whole texts, combined per task before they are shuffled; a digest that
    several texts have (``digest`` may be another function than SHA-256) is split by text. Hot groups are not shuffled.
    """
    rows, groups, total, _ = _grouped(docs, id_col, text_col, runs, digest)
    found = _of_groups(rows, groups, total)
    return found.select(
        F.col("doc_id").alias(id_col), F.col("ident.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("_row") == F.col("ident.row")).alias("kept"), F.col("digest").alias("text_sha256"), "n_cp"
    )


def first_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 4) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` does not keep, all columns.

    Only rows that may be hits, by a filter of bounded size, are shuffled; the others stay as they are scanned. Awkward rows
    count as in :func:`exact_dedup`; of rows equal in id, length and normalised text one stays.
    """
    c, names = F.col, docs.columns
    rows, groups, total, repeated = _grouped(docs, id_col, text_col, runs, sha256_hex)
    if not repeated:
        return docs
    many = groups.filter("n > 1")
    h = _row_hash(c(id_col), _n_cp(c(text_col)))
    asked, maybe = maybe_in(docs, h, _of_groups(rows, many, total).select(_row_hash(c("doc_id"), c("n_cp")).alias("h")), repeated)
    stays = groups.select(c("digest").alias("_d"), c("ident.id").alias("_id"), c("ident.neg").alias("_neg"))
    sure = asked.filter(~maybe).select(*names)
    again = asked.filter(maybe).select(*names, sha256_hex(normalised(c(text_col))).alias("_dig"), _n_cp(c(text_col)).alias("_n"), F.monotonically_increasing_id().alias("_at"))
    one = again.withColumn("_k", F.row_number().over(Window.partitionBy("_dig", id_col, "_n").orderBy("_at"))).filter("_k = 1")
    kept = one.join(stays, (c("_dig") == c("_d")) & c(id_col).eqNullSafe(c("_id")) & (c("_n") == -c("_neg")), "left_semi").select(*names)
    return sure.unionByName(kept)
