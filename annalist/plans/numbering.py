"""Dense row numbers over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.plans.staging import stage


def numbered(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """``df`` with ``name``, 1 to n in the order of the columns ``order``.

    Rows are dealt out by ranges of the order and written, so that a row's range cannot change; each range is numbered by
    itself and moved on by the sizes of the ranges before it, of which there are as many as partitions.
    """
    ranges = stage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_inside", inside).join(sizes, "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")
