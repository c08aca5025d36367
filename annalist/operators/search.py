"""Keyword search over entries, by scan and by an index of character trigrams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.plans.numbering import numbered
from annalist.plans.staging import discard, new_path, stage

#: Signs of a gram; rows of a block, whose places fit into 16 bits; blocks of a folder of rows.
GRAM, BLOCK_ROWS, SHARD_BLOCKS = 3, 1024, 64


def score(text: Column, words: Sequence[str]) -> Column:
    """How many keywords occur inside the lower-cased text; a keyword listed twice counts twice."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def top_entries(entries: DataFrame, words: Sequence[str], n: int = 20, order: str = "id", text: str = "text") -> DataFrame:
    """The ``n`` entries with the best score above zero; ties keep the order of ``order``."""
    hits = entries.withColumn("score", score(F.col(text), words)).filter("score > 0")
    return hits.orderBy(F.desc("score"), order).limit(n)


def any_keyword(entries: DataFrame, words: Sequence[str], text: str = "text") -> DataFrame:
    """Entries with any keyword."""
    return entries.filter(score(F.col(text), words) > 0)


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _grams(low: Column) -> Column:
    """Distinct trigrams; a shorter text is its own gram. Matches of nothing in front of three signs overlap, so one pass finds all."""
    many = F.regexp_extract_all(low, F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1))
    return F.when(F.length(low) < GRAM, F.array(low)).otherwise(F.array_distinct(many))


def _block_postings(t: pa.Table) -> pa.Table:
    """Grams of a block's texts (``low``) with the places of the rows that hold them."""
    held: dict[str, list[int]] = {}
    for at, low in sorted(zip(t["_at"].to_pylist(), t["low"].to_pylist(), strict=True)):
        for g in {low} if len(low) < GRAM else {low[i : i + GRAM] for i in range(len(low) - GRAM + 1)}:
            held.setdefault(g, []).append(at)
    return pa.table({"gram": pa.array(list(held), pa.string()), "_block": pa.array([t["_block"][0].as_py()] * len(held), pa.int32()), "places": pa.array(list(held.values()), pa.list_(pa.int16()))})


@dataclass
class TextIndex:
    """Rows in blocks, in folders by ``_shard``, and for each gram and block the places of the rows in the block that hold the gram.

    Postings are sorted by gram, so that a lookup reads only the row groups whose smallest and largest gram include one asked for;
    rows are read from the folders alone in which some row may match.
    """

    rows: DataFrame
    postings: DataFrame
    text: str

    def candidates(self, words: Sequence[str]) -> DataFrame:
        """``_block``, ``_at`` of the rows that hold all grams of one of the words; a superset of the rows that hold a word.

        A word that is shorter than a gram is looked for in all grams.
        """
        words = sorted(set(words))
        long = {w: sorted({w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}) for w in words if len(w) >= GRAM}
        short = [w for w in words if len(w) < GRAM]
        asked = F.col("gram").isin(sorted({g for gs in long.values() for g in gs}))
        for w in short:
            asked = asked | F.contains("gram", F.lit(w))
        none = F.array().cast("array<smallint>")
        per = self.postings.filter(asked).groupBy("_block").agg(F.collect_list(F.struct("gram", "places")).alias("p"))
        of = lambda g: F.coalesce(F.get(F.filter("p", lambda x: x["gram"] == g), 0)["places"], none)
        held = []
        for gs in long.values():
            both = of(gs[0])
            for g in gs[1:]:
                both = F.array_intersect(both, of(g))
            held.append(both)
        within = lambda w: F.flatten(F.transform(F.filter("p", lambda x: F.contains(x["gram"], F.lit(w))), lambda x: x["places"]))
        held += [within(w) for w in short]
        return per.select("_block", F.explode(F.array_distinct(F.flatten(F.array(*held)))).alias("_at"))

    def matching(self, words: Sequence[str]) -> DataFrame:
        """Rows with any of the words and their ``score``, the same as by a scan; only rows that hold the words' grams are read and verified."""
        if not words:
            return self.rows.withColumn("score", F.lit(0)).drop("_shard", "_block", "_at").limit(0)
        rows = self.rows
        if "" not in words:  # which is in every text
            found = self.candidates(words).withColumn("_shard", F.floor(F.col("_block") / SHARD_BLOCKS).cast("int"))
            rows = rows.join(found, ["_shard", "_block", "_at"])
        return rows.withColumn("score", score(F.col(self.text), words)).filter("score > 0").drop("_shard", "_block", "_at")

    def share_read(self, words: Sequence[str]) -> float:
        """Share of the rows that :meth:`matching` verifies."""
        n = self.rows.count()
        return self.candidates(words).count() / n if n else 0.0


def build_index(entries: DataFrame, order: Sequence[str], text: str = "text") -> TextIndex:
    """Write a :class:`TextIndex` over ``text`` of the entries, numbered in ``order``; it lasts as long as the shared folder does.

    Null texts are empty. Postings are one row per gram and block of ``BLOCK_ROWS`` rows, so a gram that all texts hold is
    many rows of bounded size, and they are dealt out by gram and block.
    """
    spark = entries.sparkSession
    rows = numbered(entries, order, "_id").withColumn("_at", F.pmod(F.col("_id") - 1, F.lit(BLOCK_ROWS)).cast("smallint"))
    rows = rows.withColumn("_block", F.floor((F.col("_id") - 1) / BLOCK_ROWS).cast("int")).drop("_id").withColumn("_shard", F.floor(F.col("_block") / SHARD_BLOCKS).cast("int"))
    path = new_path(spark, "index")
    rows.repartition("_shard", F.pmod("_block", F.lit(4))).write.partitionBy("_shard").parquet(path)
    held = spark.read.schema(rows.schema).parquet(path)
    low = held.select("_block", "_at", _low(F.col(text)).alias("low"))
    made = stage(low.groupBy("_block").applyInArrow(_block_postings, "gram string, _block int, places array<smallint>"), "made")
    postings = stage(made.repartitionByRange("gram", "_block").sortWithinPartitions("gram", "_block"), "postings")
    discard(made)
    return TextIndex(held, postings, text)


def top_indexed(index: TextIndex, words: Sequence[str], n: int = 20, order: str = "id") -> DataFrame:
    """:func:`top_entries` by the index."""
    return index.matching(words).orderBy(F.desc("score"), order).limit(n)
