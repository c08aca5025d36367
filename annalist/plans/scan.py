"""Last and next known values along an order, with groups of any size spread over all tasks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.plans.staging import stage


def known_around(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, before: str, after: str | None = None, own: bool = False) -> DataFrame:
    """``rows`` with the last known (not null) ``value`` before each row of a group and, if asked for, the next one ``after`` it.

    ``own``: a row's value counts for itself too. A null is a group of its own. The same rows as by windows over groups, but rows are
    dealt out by ranges of group and order, so that a large group is many ranges; each is solved by itself, and the first and
    last known values of ranges that share a group, two rows a range at most, are carried on by a second pass. Rows that are
    equal in group and order are in one range, in any order, as in a window.
    """
    c, by = F.col, list(by)
    ranges = stage(rows.withColumn("_value", F.when(value.isNotNull(), F.struct(value.alias("x")))).repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *by).orderBy(*order)
    up, down = inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1), inside.rowsBetween(0 if own else 1, Window.unboundedFollowing)
    solved = ranges.withColumn("_before", F.last("_value", ignorenulls=True).over(up)).withColumn("_after", F.first("_value", ignorenulls=True).over(down))
    known = F.col("_value").isNotNull()
    place = F.struct(*order)
    ends = ranges.groupBy("_range", *by).agg(F.max_by("_value", F.when(known, place)).alias("_last"), F.min_by("_value", F.when(known, place)).alias("_first"))
    group = Window.partitionBy(*by)
    shared = ends.withColumn("_n", F.count("*").over(group)).filter("_n > 1")
    along = group.orderBy("_range")
    carried = stage(
        shared.withColumn("_from", F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_to", F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)))
        .select(c("_range").alias("_r"), *[c(b).alias(f"_by{i}") for i, b in enumerate(by)], "_from", "_to"),
        "carried",
    )
    same = reduce(lambda x, y: x & y, [c(b).eqNullSafe(c(f"_by{i}")) for i, b in enumerate(by)], c("_range") == c("_r"))
    out = solved.join(F.broadcast(carried), same, "left")  # a group or two for each range
    out = out.withColumn(before, F.coalesce("_before", "_from")["x"])
    if after:
        out = out.withColumn(after, F.coalesce("_after", "_to")["x"])
    return out.select(*rows.columns, before, *([after] if after else []))
