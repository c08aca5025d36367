"""Density clusters from the exact spanning tree of mutual reachabilities: HDBSCAN, and DBSCAN at any distance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.operators import blocks as B
from annalist.plans.numbering import numbered
from annalist.plans.staging import discard, stage

#: Nearest rows that are listed of each row; with more, fewer rows have to be compared with all others again.
LISTED = 16
#: Edges of the tree that one task merges.
RANGE_EDGES = 1 << 17
#: Smallest distance whose inverse is used.
FLOOR = 1e-9


@dataclass
class Reach:
    """Nearest rows of each row (``k``, ``near``, ``core``) and the spanning tree of their mutual reachabilities (``a``, ``b``, ``w``)."""

    rows: DataFrame
    tree: DataFrame


def _pointed(picks: DataFrame) -> DataFrame:
    """``c``, ``root``: where following ``c`` to ``to`` ends; of two that point at each other the smaller is the end."""
    c = F.col
    back = picks.select(c("c").alias("_c"), c("to").alias("_back"))
    now = picks.join(back, c("to") == c("_c"), "left").select("c", F.when((c("_back") == c("c")) & (c("c") < c("to")), c("c")).otherwise(c("to")).alias("root"))
    now = stage(now, "pointers")
    while True:
        up = now.select(c("c").alias("_c"), c("root").alias("_up"))
        moved = stage(now.join(up, c("root") == c("_c"), "left").select("c", F.coalesce("_up", "root").alias("root"), (c("_up") != c("root")).alias("moved")), "pointers")
        discard(now)
        now = moved
        if now.filter("moved").isEmpty():
            return now.select("c", "root")


def _prim(t: pa.Table) -> pa.Table:
    """The spanning tree of one block's mutual reachabilities."""
    k, v, core = B.keys(t["k"]), B.matrix(t["v"]), np.asarray(t["core"], float)
    n = len(k)
    best, link, out = np.full(n, np.inf), np.zeros(n, int), []
    free, i = np.ones(n, bool), 0
    for _ in range(n - 1):
        free[i] = False
        w = np.maximum(np.sqrt(((v - v[i]) ** 2).sum(-1)), np.maximum(core, core[i]))
        nearer = free & (w < best)
        best[nearer], link[nearer] = w[nearer], i
        i = int(np.where(free, best, np.inf).argmin())
        out.append((link[i], i, best[i]))
    x, y, w = zip(*out, strict=True) if out else ((), (), ())
    ends = [sorted((k[a], k[b])) for a, b in zip(x, y, strict=True)]
    return pa.table({"a": pa.array([e[0] for e in ends], t["k"].type), "b": pa.array([e[1] for e in ends], t["k"].type), "w": pa.array(w, pa.float64())})


def mutual_reach(rows: DataFrame, key: str, samples: int = 3, listed: int = LISTED) -> Reach:
    """The minimum spanning tree of mutual reachabilities, exact, of vectors ``v`` with distinct keys.

    The mutual reachability of two rows is the largest of their Euclidean distance and both core distances, a core distance
    being that to the ``samples``-th nearest other row (the farthest one, if there are fewer). Rounds of Borůvka's method: each
    component takes its smallest edge to another one, ties by the ends' keys, and those that are joined become one. A
    component's smallest edge among the ``listed`` nearest rows is its smallest of all if none of its rows could have a closer
    one that is not listed; where that is not so for half of the components, the rows in doubt, but for those of the largest component, are
    compared with all others. So each round at least halves the components but one, and the largest one is never searched. Rows that
    are one block are solved by its task.
    """
    c = F.col
    data, blocks = B.in_blocks(rows, key)
    want = max(listed, samples)
    core = F.coalesce(F.get(F.col("near.d"), F.least(F.lit(samples), F.size("near")) - 1), F.lit(0.0))
    last = F.when(F.size("near") == want, c("near")[want - 1]["d"]).otherwise(float("inf"))
    lists = stage(B.nearest_rows(data, blocks, want).withColumn("core", core).withColumn("bound", F.greatest("core", last)), "near")
    if blocks == 1:
        kind = data.schema["k"].dataType.simpleString()
        found = data.join(lists.select("k", "core"), "k").groupBy("block").applyInArrow(_prim, f"a {kind}, b {kind}, w double")
        return Reach(lists.select("k", "near", "core"), stage(found, "tree"))
    cores = lists.select(c("k").alias("hi"), c("core").alias("_core"))
    pairs = lists.select(c("k").alias("a"), "core", F.explode("near").alias("x")).select("a", c("x.k").alias("hi"), F.greatest("core", "x.d").alias("w"))
    pairs = pairs.join(cores, "hi").select(F.least("a", "hi").alias("lo"), F.greatest("a", "hi").alias("hi"), F.greatest("w", "_core").alias("w"))
    edges = stage(pairs.distinct(), "edges")
    nodes = stage(lists.select("k", "core", "bound", c("k").alias("comp")), "nodes")
    tree: list[DataFrame] = []
    while True:
        left = nodes.agg(F.count_distinct("comp")).first()[0]
        if left <= 1:
            break
        x, y = nodes.select(c("k").alias("lo"), c("comp").alias("ca")), nodes.select(c("k").alias("hi"), c("comp").alias("cb"))
        live = stage(edges.select("lo", "hi", "w").join(x, "lo").join(y, "hi").filter("ca <> cb"), "edges")
        discard(edges)
        edges = live
        ends = live.select(c("ca").alias("c"), F.struct("w", "lo", "hi").alias("e"), c("cb").alias("to")).unionByName(live.select(c("cb").alias("c"), F.struct("w", "lo", "hi").alias("e"), c("ca").alias("to")))
        best = stage(ends.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.e", "m.to"), "best")
        doubt = nodes.join(best, c("comp") == c("c"), "left").filter(c("e").isNull() | (c("bound") < c("e.w"))).select("k", "comp")
        doubt = stage(doubt, "doubt")
        sure = best.join(doubt.select(c("comp").alias("c")).distinct(), "c", "left_anti")
        if 2 * sure.count() < left - 1:
            largest = nodes.groupBy("comp").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "comp").first()["comp"]
            full = data.join(nodes, "k")
            asked = stage(full.join(doubt.filter(c("comp") != F.lit(largest)).select("k"), "k", "left_semi"), "asked")
            found = stage(B.nearest_of_others(asked, full, blocks), "found")
            more = found.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "w")
            grown = stage(live.select("lo", "hi", "w").unionByName(more).distinct(), "edges")
            known = found.select(c("a").alias("k"), c("w").alias("_w"))
            wider = stage(nodes.join(known, "k", "left").select("k", "core", F.greatest("bound", F.coalesce("_w", "bound")).alias("bound"), "comp"), "nodes")
            for x in (edges, nodes, best, doubt, asked, found):
                discard(x)
            edges, nodes = grown, wider
            continue
        picks = stage(sure, "picks")
        tree.append(stage(picks.select("e.lo", "e.hi", "e.w").distinct(), "tree"))
        roots = stage(_pointed(picks.select("c", "to")), "roots")
        merged = stage(nodes.join(roots, c("comp") == c("c"), "left").select("k", "core", "bound", F.coalesce("root", "comp").alias("comp")), "nodes")
        for x in (nodes, best, doubt, picks, roots):
            discard(x)
        nodes = merged
    out = lists.select(c("k").alias("lo"), c("k").alias("hi"), c("core").alias("w")).limit(0)
    for part in tree:
        out = out.unionByName(part)
    out = stage(out.select(c("lo").alias("a"), c("hi").alias("b"), "w"), "tree")
    for x in (*tree, data, edges, nodes):
        discard(x)
    return Reach(lists.select("k", "near", "core"), out)


@dataclass
class _Part:
    """A component while distances grow: its size, and the cluster that it is, if it has enough rows."""

    comp: object
    size: int = 1
    cluster: int | None = None
    total: float = 0.0  # of the inverse distances at which rows leave the cluster
    formed: float = -1.0
    split: bool = False
    below: float = 0.0  # best stability of the clusters that it splits into
    recent: float = -1.0  # distance of the last merge
    young: list = field(default_factory=list)  # components of earlier ranges in it whose rows have no cluster yet


STATE = ["size", "cluster", "total", "formed", "split", "below", "recent"]


def _merge_range(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
    """Merge components along edges of growing ``w``; rows of what became of components (``comp``), of first clusters (``first``) and of
    clusters that ended (``done``).

    All that meet at one distance are joined at once, in whatever order their edges come: a cluster that is formed at the
    distance at which it meets another one is not a cluster of its own, and rows are of the cluster that they come to only if it goes on
    beyond that distance.
    """
    parts: dict = {}
    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    pdf = pdf.sort_values("id", ignore_index=True)
    for side in ("a", "b"):
        for comp, *state in pdf[[f"c{side}", *[f"{s}_{side}" for s in STATE]]].drop_duplicates(f"c{side}").itertuples(index=False):
            if comp not in parts:
                size, cluster, total, formed, split, below, recent = state
                parts[comp] = _Part(comp) if pd.isna(size) else _Part(comp, int(size), None if pd.isna(cluster) else int(cluster), total, formed, bool(split), below, recent)
                parts[comp].young.append(comp)
                up[comp] = comp
    rows: list[tuple] = []

    def end(x: _Part, parent: int, lam: float) -> float:
        own = x.total - x.size * lam
        rows.append(("done", None, None, x.cluster, parent, own, x.below))
        return max(own, x.below)

    for number, w, p, q in zip(pdf["id"].tolist(), pdf["w"].tolist(), pdf["ca"].tolist(), pdf["cb"].tolist(), strict=True):
        x, y = parts[find(p)], parts[find(q)]
        lam = 1 / max(w, FLOOR)
        for z in (x, y):
            if z.cluster is not None and z.recent < w:
                rows += [("first", c, None, z.cluster) for c in z.young]
                z.young = []
        if x.cluster is None and y.cluster is None:
            x.size += y.size
            if x.size >= least:
                x.cluster, x.total, x.formed = number, x.size * lam, w
        elif x.cluster is None or y.cluster is None:
            x, y = (y, x) if x.cluster is None else (x, y)
            x.size, x.total = x.size + y.size, x.total + y.size * lam
        elif x.formed < w and y.formed < w:
            below = end(x, number, lam) + end(y, number, lam)
            size = x.size + y.size
            x.size, x.cluster, x.total, x.formed, x.split, x.below = size, number, size * lam, w, True, below
        else:
            x, y = (y, x) if x.formed < w or (y.formed == w and y.split and not x.split) else (x, y)  # x is formed here
            if y.formed < w and x.split:
                x.below += end(y, x.cluster, lam)
            elif y.formed < w:  # only its rows come to the older one
                x, y = y, x
            else:
                if y.split:
                    rows.append(("done", None, None, y.cluster, x.cluster, None, y.below))
                x.below += y.below
            x.size, x.total = x.size + y.size, x.total + y.size * lam
        x.young, x.recent = x.young + y.young, w
        up[y.comp] = x.comp
        del parts[y.comp]
    for comp in up:
        x = parts[find(comp)]
        rows.append(("comp", comp, x.comp, x.cluster, None, None, None, x.size, x.total, x.formed, x.split, x.below, x.recent))
    kinds = ["what", "comp", "to", "cluster", "parent", "own", "below", "size", "total", "formed", "split", "sub", "recent"]
    return pd.DataFrame([r + (None,) * (len(kinds) - len(r)) for r in rows], columns=kinds).astype({"cluster": "Int64", "parent": "Int64", "size": "Int64", "split": "boolean"})


def stable_clusters(reach: Reach, least: int = 8) -> DataFrame:
    """HDBSCAN's most stable clusters: ``k``, ``cluster`` (its smallest key; null for noise).

    As the distance falls, a component of the tree of at least ``least`` rows lives on, loses rows, or splits into several that
    are large enough. A cluster's stability is the sum over its rows of the growth of 1 / distance from its birth until they leave; of a
    cluster and those that it splits into the more stable ones are taken, the cluster itself on ties. The whole table is no
    cluster. Splits at one distance are one split. Edges are merged from the smallest up, ``RANGE_EDGES`` of them in a task;
    what a range leaves is carried on by joins, and so are the clusters' ancestors.
    """
    c = F.col
    kind = reach.rows.schema["k"].dataType.simpleString()
    edges = stage(numbered(reach.tree, ["w", "a", "b"]), "ordered")
    n = edges.count()
    nodes = stage(reach.rows.select("k", c("k").alias("comp"), F.lit(None).cast("long").alias("first")), "nodes")
    states = None
    schema = f"what string, comp {kind}, to {kind}, cluster long, parent long, own double, below double, size long, total double, formed double, split boolean, sub double, recent double"
    done: list[DataFrame] = []
    for start in range(0, n, RANGE_EDGES):
        part = edges.filter((c("id") > start) & (c("id") <= start + RANGE_EDGES))
        for side in ("a", "b"):
            part = part.join(nodes.select(c("k").alias(side), c("comp").alias(f"c{side}")), side)
            if states is None:
                part = part.withColumns({f"{s}_{side}": F.lit(None).cast({"cluster": "long", "size": "long", "split": "boolean"}.get(s, "double")) for s in STATE})
            else:
                part = part.join(states.select(c("comp").alias(f"c{side}"), *[c(s).alias(f"{s}_{side}") for s in STATE]), f"c{side}", "left")
        out = stage(part.withColumn("_r", F.floor((c("id") - 1) / RANGE_EDGES)).groupBy("_r").applyInPandas(lambda p: _merge_range(p, least), schema), "range")
        done.append(out)
        moved = out.filter("what = 'comp'").select(c("comp").alias("_c"), c("to").alias("_to"))
        first = out.filter("what = 'first'").select(c("comp").alias("_f"), c("cluster").alias("_first"))
        now = nodes.join(moved, c("comp") == c("_c"), "left").join(first, c("comp") == c("_f"), "left")
        now = stage(now.select("k", F.coalesce("_to", "comp").alias("comp"), F.coalesce("first", "_first").alias("first")), "nodes")
        discard(nodes)
        nodes = now
        fresh = out.filter("what = 'comp' AND comp = to").select("comp", "size", "cluster", "total", "formed", "split", c("sub").alias("below"), "recent")
        states = stage(fresh if states is None else states.join(moved, c("comp") == c("_c"), "left_anti").unionByName(fresh), "states")
    if not done:
        return reach.rows.select("k", F.lit(None).cast(kind).alias("cluster"))
    ended = done[0]
    for x in done[1:]:
        ended = ended.unionByName(x)
    good = c("own").isNotNull() & (c("own") >= c("below"))
    tree = stage(ended.filter("what = 'done'").select(c("cluster").alias("c"), "parent", F.when(good, c("cluster")).alias("top")), "clusters")
    while not tree.filter("parent IS NOT NULL").isEmpty():  # the topmost one that is taken, by pointers twice as long each time
        up = tree.select(c("c").alias("_c"), c("parent").alias("_parent"), c("top").alias("_top"))
        longer = stage(tree.join(up, c("parent") == c("_c"), "left").select("c", c("_parent").alias("parent"), F.coalesce("_top", "top").alias("top")), "clusters")
        discard(tree)
        tree = longer
    named = nodes.join(tree, c("first") == c("c"), "left").select("k", "top")
    names = named.filter("top IS NOT NULL").groupBy("top").agg(F.min("k").alias("cluster"))
    return named.join(names, "top", "left").select("k", "cluster")


def hierarchical_density(rows: DataFrame, key: str, least: int = 8, samples: int = 3, listed: int = LISTED) -> DataFrame:
    """HDBSCAN of the vectors ``v`` by Euclidean distance: ``key``, ``cluster`` (its smallest key; null for noise).

    Exact, see :func:`mutual_reach` and :func:`stable_clusters`. Keys are distinct; rows with a null key are noise; an empty
    table gives an empty result.
    """
    found = stable_clusters(mutual_reach(rows, key, samples, listed), least)
    return rows.select(key).join(found.select(F.col("k").alias("_k"), "cluster"), F.col(key) == F.col("_k"), "left").select(key, "cluster")


def _cut_range(pdf: pd.DataFrame, cuts: Sequence[int]) -> pd.DataFrame:
    """Components after some of the range's edges, and after all of it (``cut`` null): ``cut``, ``comp``, ``to``."""
    up: dict = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    rows, left = [], sorted(cuts)
    for number, a, b in pdf.sort_values("id")[["id", "ca", "cb"]].itertuples(index=False):
        x, y = sorted((find(a), find(b)))
        up[y] = x
        while left and left[0] == number:
            rows += [(left[0], z, find(z)) for z in list(up)]
            left.pop(0)
    rows += [(None, z, find(z)) for z in list(up)]
    return pd.DataFrame(rows, columns=["cut", "comp", "to"]).astype({"cut": "Int64"})


def density_sweep(reach: Reach, distances: Sequence[float], least: int) -> DataFrame:
    """DBSCAN at every one of several distances from one tree: ``eps``, ``k``, ``cluster`` (its smallest core key; null for noise).

    ``reach`` is made with ``samples`` = ``least`` - 1, so a row is a core at a distance that is at least its core distance, and
    cores are joined just by the tree's edges up to it. Edges are merged once, from the smallest up, ``RANGE_EDGES`` in a task, which
    tells the components at the distances that it passes. A row that is no core joins its nearest core, if that is in reach; being no core, it
    has all rows in reach among its nearest ones.
    """
    c, distances = F.col, sorted(set(map(float, distances)))
    kind = reach.rows.schema["k"].dataType.simpleString()
    edges = stage(numbered(reach.tree, ["w", "a", "b"]), "ordered")
    sums = edges.agg(F.count("*").alias("n"), *[F.count_if(c("w") <= e).alias(f"e{i}") for i, e in enumerate(distances)]).first()
    passed = dict(zip(distances, sums[1:], strict=True))
    rows, comps = reach.rows, stage(reach.rows.select("k", c("k").alias("comp")), "comps")
    at = {e: comps for e, m in passed.items() if not m}
    for start in range(0, sums["n"], RANGE_EDGES):
        cuts = {m: e for e, m in passed.items() if start < m <= start + RANGE_EDGES}
        part = edges.filter((c("id") > start) & (c("id") <= start + RANGE_EDGES))
        for side in ("a", "b"):
            part = part.join(comps.select(c("k").alias(side), c("comp").alias(f"c{side}")), side)
        places = sorted(cuts)
        out = part.withColumn("_r", F.floor((c("id") - 1) / RANGE_EDGES)).groupBy("_r").applyInPandas(lambda p: _cut_range(p, places), f"cut long, comp {kind}, to {kind}")  # noqa: B023
        out = stage(out, "cuts")
        moved = lambda which: out.filter(which).select(c("comp").alias("_c"), c("to").alias("_to"))  # noqa: B023, E731
        after = lambda which: comps.join(moved(which), c("comp") == c("_c"), "left").select("k", F.coalesce("_to", "comp").alias("comp"))  # noqa: B023, E731
        at |= {e: after(c("cut") == m) for e, m in passed.items() if m in cuts}
        comps = stage(after(c("cut").isNull()), "comps")
    parts = []
    for eps in distances:
        now = rows.join(at[eps], "k")
        cores = now.filter((c("core") <= eps) & (F.size("near") >= least - 1)).select("k", "comp")
        names = cores.groupBy("comp").agg(F.min("k").alias("cluster"))
        cores = stage(cores.join(names, "comp").select("k", "cluster"), "dbscan")
        rest = rows.join(cores, "k", "left_anti").select("k", F.explode("near").alias("x")).filter(c("x.d") <= eps)
        border = rest.join(cores.select(c("k").alias("_k"), "cluster"), c("x.k") == c("_k")).groupBy("k").agg(F.min(F.struct("x.d", "x.k", "cluster")).alias("m")).select("k", "m.cluster")
        parts.append(rows.select("k").join(cores.unionByName(border), "k", "left").select(F.lit(eps).alias("eps"), "k", "cluster"))
    return stage(reduce(DataFrame.unionByName, parts), "sweep")


def best_distance(sweep: DataFrame, ceiling: float = 0.3) -> DataFrame:
    """Per ``eps`` its ``clusters``, ``noise`` (share of rows) and whether it is ``chosen``: of those with two clusters or more and less noise
    than ``ceiling`` the one with most clusters, then least noise, then the smallest."""
    c = F.col
    per = sweep.groupBy("eps").agg(F.count_distinct("cluster").alias("clusters"), F.avg(c("cluster").isNull().cast("double")).alias("noise"))
    fits = (c("clusters") >= 2) & (c("noise") < ceiling)
    best = per.filter(fits).agg(F.max_by("eps", F.struct("clusters", -c("noise"), -c("eps"))).alias("_best"))  # one row
    return per.crossJoin(F.broadcast(best)).select("eps", "clusters", "noise", (c("eps").eqNullSafe(c("_best"))).alias("chosen"))
