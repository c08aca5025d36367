"""Connected components of an edge list, as joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.plans.staging import discard, stage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Label each endpoint of ``edges`` with the smallest endpoint it can reach: columns ``node``, ``component``.

    Alternates two steps until the edge set no longer changes: every vertex hands its larger neighbours to the smallest
    vertex of its neighbourhood, then its smaller ones. Each step is a partial ``min`` aggregate and an equi-join, so a
    hub with very many neighbours is never gathered in one place. Rounds grow with the logarithm of the diameter. Rows
    with a null endpoint and self loops are ignored; an empty edge list gives an empty result; repeated edges count once.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("_x"), F.col(b).isNotNull().alias("_y"))
    e = stage(e.filter("_x and _y and u > v").select("u", "v").distinct(), "edges")
    seen = _signature(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        now = _signature(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
