"""The segmented scan against windows, and on one group that holds all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.operators import dating, vectors
from annalist.plans.scan import known_around


@pytest.mark.parametrize("own", [False, True])
def test_known_around_equals_windows(spark, own):
    r = random.Random(3)
    rows = [(g, i, r.randint(0, 99) if r.random() < 0.1 else None) for g, n in (("a", 900), (None, 200), ("b", 3), ("c", 1), ("d", 150)) for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, pos int, x int").repartition(7)
    w = Window.partitionBy("g").orderBy("pos")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0 if own else -1), w.rowsBetween(0 if own else 1, Window.unboundedFollowing)
    want = df.withColumn("p", F.last("x", ignorenulls=True).over(up)).withColumn("n", F.first("x", ignorenulls=True).over(down))
    got = known_around(df, ["g"], ["pos"], F.col("x"), "p", "n", own)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert known_around(df.limit(0), ["g"], ["pos"], F.col("x"), "p").count() == 0


def test_one_group_is_spread(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.lit("all").alias("doc_id"), F.col("id").alias("pos"), F.when(F.col("id") % 7000 == 3, F.col("id")).alias("x"))
        got = known_around(df, ["doc_id"], ["pos"], F.col("x"), "p", "n")
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 1 and max(sizes) < 15_000
        row = {r["pos"]: (r["p"], r["n"]) for r in got.filter("pos IN (0, 3, 4, 6999, 7003, 14003, 14004, 19999)").collect()}
        assert row == {0: (None, 3), 3: (None, 7003), 4: (3, 7003), 6999: (3, 7003), 7003: (3, 14003), 14003: (7003, None), 14004: (14003, None), 19999: (14003, None)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_interpolation_of_spread_documents(spark):
    r = random.Random(5)
    rows = [(d, p, s, y, y, r.random() < 0.1) for d in range(3) for p in range(120) for s, y in [(r.choice(["s", None]), r.choice([None, None, None, 1900 + r.randint(0, 99)]))]]
    df = spark.createDataFrame(rows, "doc_id long, pos long, source string, time_from int, time_to int, undatable boolean").withColumn("precision", F.when(F.col("time_from").isNotNull(), "exact"))
    assert sorted(map(str, dating.interpolate(df, spread=True).collect())) == sorted(map(str, dating.interpolate(df).collect()))


def test_neighbour_mean(spark):
    df = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(9)] + [("b", 1, [3.0, 4.0])], "label string, k int, v array<double>")
    got = {(r["label"], r["k"]): r["v"] for r in vectors.neighbour_mean(df, "label", "k", F.col("k") % 2 == 1).collect()}
    n = (9.0 + 9.0) ** 0.5
    assert got["a", 1] == pytest.approx([3 / n, 3 / n]) and got["a", 2] == [2.0, 1.0] and got["b", 1] == pytest.approx([0.6, 0.8])
