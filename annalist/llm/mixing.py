"""Mixing sources to target weights by bounded subset sums over exact length counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.plans.staging import stage

#: Words of one document: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one (source, length) group that are ranked together; larger groups are ranked in several buckets.
RANK_ROWS = 1024
#: Largest remainder, in words, that the knapsack table spans.
KNAPSACK_WORDS = 1 << 15


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, cap: float) -> DataFrame:
    """Targets of sources from their sizes (columns ``source``, ``source_size``).

    Sources in code point order, null last, take ``weights`` in turn and share ``budget`` times the total. Where a share
    exceeds ``cap`` times the source's size it stops there and the excess goes to the others by weight. Sorted by
    size over weight, the sources that stop are a prefix, so running sums give the fixed point at once. One row per
    source: the only thing the single-partition windows ever see.
    """
    ranked = sizes.withColumn("_rk", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("_rk") - 1, F.lit(len(weights))) + 1)
    ranked = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * float(cap))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rk").rowsBetween(Window.unboundedPreceding, -1)
    run = (
        ranked.withColumn("_all", F.sum("source_size").over(every) * float(budget))
        .withColumn("_lam", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
        .withColumn("_open", F.col("_cap") > F.col("_lam") * F.col("_w"))
    )
    lam = F.max(F.when(F.col("_open"), F.col("_lam"))).over(every)
    return run.select("source", "source_size", F.when(F.col("_open"), lam * F.col("_w")).otherwise(F.col("_cap")).alias("target"))


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is the largest one that is at most ``budget``."""
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    by = np.full(budget + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i, (length, n) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        n, part = min(n, budget // length), 1
        while n > 0:  # counts as powers of two: each multiple is reachable with few items
            take = min(part, n)
            step = take * length
            new = np.zeros_like(reach)
            new[step:] = reach[: budget + 1 - step]
            new &= ~reach
            by[new] = len(items)
            reach |= new
            items.append((i, take))
            n, part = n - take, part * 2
        if reach[budget]:
            break
    out, at = np.zeros(len(lengths), np.int64), int(np.flatnonzero(reach)[-1])
    while at:
        i, take = items[by[at]]
        out[i] += take
        at -= take * int(lengths[i])
    return out


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = KNAPSACK_WORDS) -> np.ndarray:
    """Documents to take of each length (ascending, positive) so that the words taken come closest to ``budget``.

    An equal share of every length is taken first, which keeps the mix of short and long documents; single documents from
    the longest down bring the rest below ``window`` words, and a bounded knapsack over the remaining counts fits that.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    take = np.minimum(counts, np.floor(counts * (budget / total)).astype(np.int64))
    rest = budget - int((take * lengths).sum())
    for i in range(len(lengths) - 1, -1, -1):
        if rest <= window:
            break
        more = min(int(counts[i] - take[i]), max(0, rest - window // 2) // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    if 0 < rest <= 2 * window:
        may = np.flatnonzero((lengths <= rest) & (counts > take))
        if len(may):
            take[may] += _knapsack(lengths[may], (counts - take)[may], rest)
            rest = budget - int((take * lengths).sum())
    left = np.flatnonzero(counts > take)
    if len(left) and abs(rest - int(lengths[left[0]])) < rest:
        take[left[0]] += 1  # one more document overshoots by less than is missing
    return take


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Choose how often each document enters a mix whose sources come near weighted word targets.

    Returns one row per input row: the id, ``size`` (words), ``source`` and its ``source_size`` and ``target``, ``copies``
    (0 to ``cap``) and ``taken`` (words, repeats counted). A source whose target exceeds its size repeats every document
    whole and fits what remains by :func:`fit_lengths` over its counts by exact length; which documents of a length enter
    is decided by a seeded hash, so reruns agree. Null or empty text has size 0 and takes nothing; a null source is a
    source; repeated rows count as separate documents; an empty table gives an empty result; other columns are ignored.

    Scale: text is read once. Lengths are counted with map-side partial sums. One task sees at most the distinct lengths
    of one source (fewer than the square root of twice its words). Groups of one source and length are ranked in buckets
    of about ``RANK_ROWS`` rows, so a hot source or a hot length is spread.
    """
    c = F.col
    sized = stage(
        docs.select(
            c(id_col).alias("doc_id"), c(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(c(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), c(id_col)).alias("_h"),
        ),
        "sized",
    )
    hist = sized.groupBy("source", "size").agg(F.count("*").alias("_n"))
    totals = hist.groupBy("source").agg(F.sum(c("size") * c("_n")).alias("source_size"))
    goal = source_targets(totals, weights, budget, cap)
    most = int(cap)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = min(most, int(target // total)) if total else 0
        some = (pdf["size"] > 0).to_numpy()
        extra = np.zeros(len(pdf), np.int64)
        if total and whole < most:
            extra[some] = fit_lengths(pdf["size"].to_numpy()[some], pdf["_n"].to_numpy()[some], round(target - whole * total))
        return pdf.assign(_whole=whole, _extra=extra)[["source", "source_size", "target", "size", "_n", "_whole", "_extra"]]

    x, y = hist.alias("x"), goal.alias("y")
    plan = x.join(y, c("x.source").eqNullSafe(c("y.source"))).select("x.source", "size", "_n", "source_size", "target")
    plan = stage(plan.groupBy("source").applyInPandas(fit, "source string, source_size long, target double, size long, _n long, _whole long, _extra long"), "mixplan")
    d, p = sized.alias("d"), plan.alias("p")
    rows = d.join(p, c("d.source").eqNullSafe(c("p.source")) & (c("d.size") == c("p.size"))).select("d.*", "p.source_size", "p.target", "p._n", "p._whole", "p._extra")
    rows = rows.withColumn("_b", F.pmod(c("_h"), F.ceil(c("_n") / RANK_ROWS)))
    within = Window.partitionBy("source", "size", "_b").orderBy("_h", "doc_id")
    running = Window.partitionBy("source", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("source", "size", "_b").agg(F.count("*").alias("_bn")).withColumn("_before", F.coalesce(F.sum("_bn").over(running), F.lit(0)))
    r, b = rows.withColumn("_rn", F.row_number().over(within)).alias("r"), buckets.alias("b")
    joined = r.join(b, c("r.source").eqNullSafe(c("b.source")) & (c("r.size") == c("b.size")) & (c("r._b") == c("b._b")))
    copies = c("r._whole") + (c("r._rn") <= c("r._extra") - c("b._before")).cast("long")
    return joined.select(
        c("r.doc_id").alias(id_col), c("r.size").alias("size"), c("r.source").alias("source"), "source_size", "target", copies.alias("copies"), (copies * c("r.size")).alias("taken")
    )
