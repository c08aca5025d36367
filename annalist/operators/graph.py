"""Co-occurrence graph of actors, and time series of entries."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.plans.staging import discard, stage

#: Pairs of actors of a graph that one task takes.
TAIL_EDGES = 1 << 20

# Spans in days up to which a bin is a day, a week, a month; gaps in days that a run may have, by bin.
BIN_DAYS = (("day", 50), ("week", 350), ("month", 1500))
RUN_GAP = {"day": 2, "week": 8, "month": 32, "year": 366}
DEFAULT_SPAN = ("1989-01-01", "2017-12-31")


def edges(rows: DataFrame, least: int = 2) -> DataFrame:
    """Edges of actors (``a`` < ``b``) per event type, whose pair occurs ``least`` times over all types.

    ``rows`` has an entry's actors with their places: ``id``, ``event_type``, ``actor``, ``i``. Each two places of an entry
    are a pair, repeats included. Pairs stay inside an entry; counts are combined before the shuffle.
    """
    p, q = rows.alias("p"), rows.select("id", "actor", "i").alias("q")
    pair = p.join(q, (F.col("p.id") == F.col("q.id")) & (F.col("p.i") < F.col("q.i")))
    pair = pair.select(F.least("p.actor", "q.actor").alias("a"), F.greatest("p.actor", "q.actor").alias("b"), F.coalesce("p.event_type", F.lit("?")).alias("event_type"))
    n = pair.groupBy("a", "b", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("_t", F.sum("n").over(Window.partitionBy("a", "b"))).filter(F.col("_t") >= least).drop("_t")


def neighbours(e: DataFrame) -> DataFrame:
    """Distinct neighbours per actor: ``actor``, ``links``."""
    both = e.select(F.col("a").alias("actor"), F.col("b").alias("other")).unionByName(e.select(F.col("b").alias("actor"), F.col("a").alias("other")))
    return both.groupBy("actor").agg(F.countDistinct("other").alias("links"))


def pair_totals(e: DataFrame) -> DataFrame:
    """Count over all event types and how many there are, per pair."""
    return e.groupBy("a", "b").agg(F.sum("n").alias("total"), F.countDistinct("event_type").alias("types"))


def core_numbers(e: DataFrame) -> DataFrame:
    """Core number of each actor: the largest ``k`` such that it is in a part of the graph whose actors have ``k`` edges each: ``actor``, ``core``.

    Parallel edges count separately. Every actor starts from its number of edges; then it takes the largest ``h`` for which ``h`` of
    its edges lead to actors with at least ``h``, until nothing changes, which is the core number. Only neighbours of actors that
    changed are counted again. Rounds end when nothing changes; as a long chain is worn off one actor a round, a graph of at
    most ``TAIL_EDGES`` pairs is finished in a task (:func:`_peel`), which bounds the rounds that small graphs take.
    """
    c = F.col
    both = e.select(c("a").alias("x"), c("b").alias("y")).unionAll(e.select(c("b").alias("x"), c("a").alias("y")))
    pairs = stage(both.groupBy("x", "y").agg(F.count("*").alias("m")), "pairs")
    if pairs.limit(2 * TAIL_EDGES + 1).count() <= 2 * TAIL_EDGES:
        return stage(pairs.filter("x <= y").groupBy(F.spark_partition_id() * 0).applyInPandas(_peel, f"actor {e.schema['a'].dataType.simpleString()}, core long"), "cores")
    now = stage(pairs.groupBy("x").agg(F.sum("m").alias("h")), "cores")
    changed = now.select("x")
    while not changed.isEmpty():
        asked = pairs.join(changed.select(c("x").alias("y")), "y", "left_semi").select("x").distinct()
        seen = pairs.join(asked, "x", "left_semi").join(now.select(c("x").alias("y"), "h"), "y")
        falling = Window.partitionBy("x").orderBy(F.desc("h")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        grouped = seen.groupBy("x", "h").agg(F.sum("m").alias("m")).withColumn("reach", F.sum("m").over(falling))
        new = grouped.groupBy("x").agg(F.max(F.least("h", "reach")).alias("_h"))
        both = stage(now.join(new, "x", "left").select("x", F.least("h", F.coalesce("_h", "h")).alias("h"), (c("_h") < c("h")).alias("fell")), "cores")
        discard(now)
        now, changed = both.select("x", "h"), both.filter("fell").select("x")
        now._staged_at = both._staged_at
    return now.select(c("x").alias("actor"), c("h").alias("core"))


def _peel(pdf: pd.DataFrame) -> pd.DataFrame:
    """Core numbers by taking the actors with the fewest edges away first."""
    names, ends = pd.factorize(pd.concat([pdf["x"], pdf["y"]]))[::-1]
    n, size = len(names), len(pdf)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    degree = [0] * n
    for i, j, m in zip(ends[:size].tolist(), ends[size:].tolist(), pdf["m"].tolist(), strict=True):
        for p, q in ((i, j), (j, i)) if i != j else ((i, j),):
            near[p].append((q, m))
            degree[p] += m
    heap, core, k = [(x, i) for i, x in enumerate(degree)], [-1] * n, 0
    heapq.heapify(heap)
    while heap:
        x, i = heapq.heappop(heap)
        if core[i] >= 0 or x != degree[i]:
            continue
        k = core[i] = max(k, x)
        for j, m in near[i]:
            if core[j] < 0:
                degree[j] -= m
                heapq.heappush(heap, (degree[j], j))
    return pd.DataFrame({"actor": names, "core": core})


def k_core(e: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """Nodes left when those with fewer than ``least`` visible edges are dropped again and again: ``actor``.

    ``nodes`` are the candidates (by rank, type and the like); parallel edges count separately.
    """
    live = nodes.select("actor").distinct()
    inside = e.join(live.select(F.col("actor").alias("a")), "a", "left_semi").join(live.select(F.col("actor").alias("b")), "b", "left_semi")
    return core_numbers(inside).filter(F.col("core") >= least).select("actor")


def ego(e: DataFrame, focus: str) -> DataFrame:
    """Edges among an actor and its neighbours."""
    near = e.filter((F.col("a") == focus) | (F.col("b") == focus))
    seen = near.select(F.col("a").alias("x")).unionAll(near.select(F.col("b").alias("x"))).distinct()
    return e.join(seen.select(F.col("x").alias("a")), "a", "left_semi").join(seen.select(F.col("x").alias("b")), "b", "left_semi")


def ranked_nodes(rows: DataFrame, most: int) -> DataFrame:
    """Actors by mentions, first seen first on ties: ``actor``, ``n``, ``rank``."""
    n = rows.groupBy("actor").agg(F.count("*").alias("n"), F.min(F.struct("id", "i")).alias("_f"))
    return n.orderBy(F.desc("n"), "_f").limit(most).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "_f"))).drop("_f")


def bin_unit(lo: Column, hi: Column) -> Column:
    """Unit of the bins of a time axis by its span."""
    span, out = F.datediff(hi, lo), None
    for unit, days in BIN_DAYS:
        out = F.when(span <= days, unit) if out is None else out.when(span <= days, unit)
    return out.otherwise("year")


def bin_start(day: Column, unit: str) -> Column:
    """First day of a bin; weeks start on Sunday."""
    if unit == "week":
        return F.date_sub(F.date_trunc("week", F.date_add(day, 1)).cast("date"), 1)
    return F.date_trunc(unit, day).cast("date")


def series(entries: DataFrame, unit: str, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Entries per bin and event type, with zeros: ``bin``, ``event_type``, ``n``.

    Bins span from ``lo`` (the first one starts there, even inside a unit) to ``hi``, by default the extent of the data;
    rows without a day are left out. The calendar times the types is small next to the entries.
    """
    rows = entries.filter(F.col("day").isNotNull())
    ext = rows.agg(F.coalesce(F.min("day"), F.lit(DEFAULT_SPAN[0]).cast("date")).alias("lo"), F.coalesce(F.max("day"), F.lit(DEFAULT_SPAN[1]).cast("date")).alias("hi"))
    if lo is not None:
        ext = ext.select(lo.alias("lo"), hi.alias("hi"))
    step = {"day": "1 day", "week": "7 days", "month": "1 month", "year": "1 year"}[unit]
    grid = F.sequence(bin_start(F.col("lo"), unit), F.col("hi"), F.expr(f"interval {step}"))
    bins = ext.select("lo", "hi", F.explode(grid).alias("_b")).select(F.greatest("lo", "_b").alias("bin"), F.col("_b"))
    types = entries.select("event_type").distinct()
    counts = rows.groupBy(bin_start(F.col("day"), unit).alias("_b"), "event_type").agg(F.count("*").alias("n"))
    full = bins.crossJoin(types).alias("f")
    c = counts.alias("c")
    return full.join(c, (F.col("f._b") == F.col("c._b")) & F.col("f.event_type").eqNullSafe(F.col("c.event_type")), "left").select("f.bin", "f.event_type", F.coalesce("c.n", F.lit(0)).alias("n"))


def runs(rows: DataFrame, by: str, day: str, gap: int) -> DataFrame:
    """Runs of days with at most ``gap`` days between two: ``start``, ``stop``, ``days``."""
    days = rows.select(by, F.col(day).alias("_d")).filter("_d IS NOT NULL").distinct()
    w = Window.partitionBy(by).orderBy("_d")
    new = F.coalesce((F.datediff("_d", F.lag("_d").over(w)) > gap).cast("int"), F.lit(1))
    return days.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).groupBy(by, "_run").agg(F.min("_d").alias("start"), F.max("_d").alias("stop"), F.count("*").alias("days")).drop("_run")


def last_nonzero(s: DataFrame) -> DataFrame:
    """Last bin with a count per series."""
    return s.filter("n > 0").groupBy("event_type").agg(F.max("bin").alias("bin"))
