"""Density clusters against plain Python: spanning tree, HDBSCAN, DBSCAN at several distances."""

import numpy as np
import pytest

from annalist.operators import blocks, density


def points(seed=11):
    """Clumps of several densities, a pair of clumps close together, noise, and repeated points."""
    g = np.random.default_rng(seed)
    e = np.eye(6)
    clumps = [(e[0], 0.05, 30), (e[0] + 0.4 * e[1], 0.05, 22), (e[3], 0.25, 40), (e[5], 0.02, 5), (2 * e[2], 0.4, 25)]
    v = np.concatenate([c + s * g.normal(size=(n, 6)) for c, s, n in clumps] + [1.5 * g.normal(size=(20, 6)), np.tile(e[4], (12, 1))])
    return v[g.permutation(len(v))]


def reach_matrix(v, samples):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, min(samples, len(v) - 1) - 1]
    return d, core, np.maximum(d, np.maximum(core[:, None], core[None]))


def parts(rows, w, below):
    """Components of ``rows`` by edges shorter than ``below``."""
    left, out = set(rows), []
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            x = todo.pop()
            comp.add(x)
            near = {y for y in left if w[x, y] < below}
            left -= near
            todo += near
        out.append(comp)
    return out


def hdbscan_by_hand(w, least):
    """Top down: (rows, stability, children) of each cluster; the whole is none."""

    def grow(rows, birth):
        alive, total = set(rows), 0.0
        while True:
            inside = sorted({w[a, b] for a in alive for b in alive if a != b}, reverse=True)
            e = next((x for x in inside if len(parts(alive, w, x)) > 1), None)
            lam = 1 / max(e, density.FLOOR)
            large = [p for p in parts(alive, w, e) if len(p) >= least]
            if len(large) == 1:
                total += (len(alive) - len(large[0])) * lam
                alive = large[0]
                continue
            total += len(alive) * lam
            return rows, total - len(rows) * birth, [grow(p, lam) for p in large]

    def best(node):
        own, below = node[1], [best(k) for k in node[2]]
        beneath = sum(x for x, _ in below)
        return (own, [node[0]]) if own >= beneath else (beneath, [t for _, x in below for t in x])

    return {frozenset(x) for k in grow(set(range(len(w))), 0.0)[2] for x in best(k)[1]}


def groups(rows, key="k"):
    out = {}
    for r in rows:
        out.setdefault(r["cluster"], set()).add(r[key])
    noise = out.pop(None, set())
    return out, noise


@pytest.mark.parametrize(("seed", "n", "listed", "rows", "edges"), [(11, 154, 16, 4096, 1 << 17), (12, 84, 3, 40, 35)])
def test_hierarchical_density_is_hdbscan(spark, monkeypatch, seed, n, listed, rows, edges):
    """In one block and one range, and by rounds over several of each."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", rows)
    monkeypatch.setattr(blocks, "TILE_ROWS", 7)
    monkeypatch.setattr(density, "RANGE_EDGES", edges)
    v = points(seed)[:n]
    _, core, w = reach_matrix(v, 3)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>").repartition(4)
    reach = density.mutual_reach(df, "k", 3, listed)
    tree = reach.tree.collect()
    left, weight = parts(range(len(v)), w, -1.0), 0.0
    index = {x: i for i, p in enumerate(left) for x in p}
    for a, b in sorted(((a, b) for a in range(len(v)) for b in range(a)), key=lambda p: w[p]):
        if index[a] != index[b]:
            old, new = index[a], index[b]
            weight += w[a, b]
            index = {x: new if i == old else i for x, i in index.items()}
    assert len(tree) == len(v) - 1 and sum(r["w"] for r in tree) == pytest.approx(weight)
    assert all(r["w"] == pytest.approx(w[r["a"], r["b"]], abs=1e-12) for r in tree)
    assert {r["k"]: r["core"] for r in reach.rows.collect()} == pytest.approx(dict(enumerate(core)))
    got, noise = groups(density.stable_clusters(reach, 8).collect())
    want = hdbscan_by_hand(w, 8)
    assert {frozenset(x) for x in got.values()} == want and len(want) >= 2 and sum(map(len, want)) + len(noise) == len(v)
    assert all(min(x) == k for k, x in got.items())


def test_hierarchical_density_odd_rows(spark):
    df = spark.createDataFrame([(f"k{i:02d}", [float(i % 4 > 1) * 9, 0.0]) for i in range(24)] + [(None, [1.0, 1.0])], "name string, v array<double>")
    got, noise = groups(density.hierarchical_density(df, "name", 5).collect(), "name")
    assert got == {"k00": {f"k{i:02d}" for i in range(24) if i % 4 < 2}, "k02": {f"k{i:02d}" for i in range(24) if i % 4 > 1}} and noise == {None}
    assert density.hierarchical_density(df.limit(0), "name").count() == 0
    assert [r["cluster"] for r in density.hierarchical_density(df.filter("name = 'k00'"), "name").collect()] == [None]
    assert groups(density.hierarchical_density(df.filter("name < 'k03'"), "name").collect(), "name") == ({}, {"k00", "k01", "k02"})


def dbscan_by_hand(d, eps, least):
    n = len(d)
    core = {i for i in range(n) if (d[i] <= eps).sum() + 1 >= least}
    out = {}
    for comp in parts(core, np.where(d <= eps, 0.0, 1.0), 0.5):
        out |= {i: min(comp) for i in comp}
    for i in set(range(n)) - core:
        near = min(((d[i, j], j) for j in core if d[i, j] <= eps), default=None)
        out[i] = out[near[1]] if near else None
    return out


@pytest.mark.parametrize("least", [2, 4])
def test_density_sweep_equals_separate_runs(spark, least):
    v = points(21)
    d, _, _ = reach_matrix(v, 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    eps = [0.05, 0.15, 0.3, 0.6]
    sweep = density.density_sweep(density.mutual_reach(df, "k", least - 1), eps, least)
    got, per = {}, {}
    for r in sweep.collect():
        got[r["eps"], r["k"]] = r["cluster"]
    for e in eps:
        want = dbscan_by_hand(d, e, least)
        assert {k: c for (x, k), c in got.items() if x == e} == want
        found = set(want.values()) - {None}
        per[e] = (len(found), sum(c is None for c in want.values()) / len(v))
    best = min((e for e in eps if per[e][0] >= 2 and per[e][1] < 0.3), key=lambda e: (-per[e][0], per[e][1], e))
    rows = density.best_distance(sweep).collect()
    assert {r["eps"]: (r["clusters"], pytest.approx(r["noise"])) for r in rows} == per and [r["eps"] for r in rows if r["chosen"]] == [best]
    assert density.best_distance(sweep, 0.0).filter("chosen").count() == 0


def test_nearest_of_others(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    monkeypatch.setattr(blocks, "TILE_ROWS", 5)
    v = points(5)
    d, core, w = reach_matrix(v, 2)
    comp = [i % 3 for i in range(len(v))]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, v array<double>")
    data, n = blocks.in_blocks(rows, "k")
    extra = spark.createDataFrame([(i, float(core[i]), comp[i]) for i in range(len(v))], "k long, core double, comp int")
    full = data.join(extra, "k")
    got = {r["a"]: (r["b"], r["w"]) for r in blocks.nearest_of_others(full.filter("comp > 0"), full, n).collect()}
    for i in range(len(v)):
        if comp[i]:
            best = min((w[i, j], j) for j in range(len(v)) if comp[j] != comp[i])
            assert got[i] == (best[1], pytest.approx(best[0]))
    assert len(got) == sum(c > 0 for c in comp) and blocks.nearest_of_others(full, full.filter("comp = 9"), n).count() == 0
    near = {r["k"]: [(x["k"], x["d"]) for x in r["near"]] for r in blocks.nearest_rows(data, n, 7).collect()}
    for i, own in near.items():
        assert np.allclose([x for _, x in own], np.sort(d[i])[:7]) and all(d[i, j] == pytest.approx(x) for j, x in own)
