"""Bitmap filters of bounded size, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group is hot if it has more than this share of all rows, so there are at most as many as its inverse.
HOT_SHARE = 1e-3
#: Bits of a filter per entry.
FILTER_BITS = 8
#: Words of the largest filter that is sent to all tasks (some 10 MB). With more entries it lets more rows pass, and loses none.
FILTER_WORDS = 1 << 18


def filter_words(entries: int, most: int | None = None) -> int:
    """64-bit words of a filter: a power of two, so that a larger filter folds onto a smaller one."""
    return min(most or FILTER_WORDS, 1 << max(0, (max(1, entries) * FILTER_BITS // 64).bit_length()))


def slot(h: Column, words: Column | int) -> tuple[Column, Column]:
    """Word of a filter and bit in it for a 64-bit hash."""
    return F.shiftright(h, 6).bitwiseAND((F.lit(words) - 1).cast("long")), h.bitwiseAND(F.lit(63)).cast("int")


def maybe_in(rows: DataFrame, h: Column, hashes: DataFrame, entries: int) -> tuple[DataFrame, Column]:
    """``rows`` with the words of a filter over the ``entries`` numbers in ``hashes`` (column ``h``), and whether a row's own
    hash may be among them. The filter's length is bounded, so it is sent to all tasks and the rows stay where they are."""
    words = filter_words(entries)
    word, bit = slot(F.col("h"), words)
    held = hashes.groupBy(word.alias("_filter_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_filter_bits"))
    word, bit = slot(h, words)
    asked = rows.withColumn("_filter_at", word)
    return asked.join(F.broadcast(held), asked["_filter_at"] == held["_filter_word"], "left"), F.coalesce(F.getbit("_filter_bits", bit) == 1, F.lit(False))


def join_groups(rows: DataFrame, groups: DataFrame, on: Column, size: Column, total: int) -> DataFrame:
    """``rows`` joined with their ``groups`` (inner) where ``on`` holds; ``size`` is a group's number of rows, ``total`` that of all.

    Hot groups, of which there are at most 1 / ``HOT_SHARE``, are sent to all tasks, so that their rows are not shuffled; rows
    of the others are.
    """
    most = max(1, int(total * HOT_SHARE))
    hot = F.broadcast(groups.filter(size > most))
    rest = rows.join(hot, on, "left_anti").join(groups.filter(size <= most), on)
    return rows.join(hot, on).unionByName(rest)
