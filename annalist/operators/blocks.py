"""Rows of vectors compared block by block: nearest others, and nearest ones of another group.

Vectors are dealt out by a hash of their key into blocks of some ``BLOCK_ROWS``; a task holds two blocks and compares them by
matrix products in tiles. What the products select is computed again as sums of squared differences, so that distances are
the same from both sides and zero for equal vectors. Work is the number of pairs, and a vector is copied once per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.plans.staging import stage

#: Vectors of a block, and of a tile. Blocks grow with the data so that there are ``BLOCKS`` at most, and a vector is copied as often at any
#: size, until they hold ``MOST_ROWS``, beyond which there are more.
BLOCK_ROWS, TILE_ROWS, BLOCKS, MOST_ROWS = 4096, 512, 16, 16384
#: Blocks past which all rows stream, as many at any size until a block's rows and sums are over ``MOST_CELLS`` numbers, and parts of
#: a tile in which rows are compared with a stream.
STREAM_BLOCKS, MOST_CELLS, STREAM_TILES = 24, 1 << 24, 2
#: Rounding of squared distances by products, relative to the largest squared length.
ROUNDING = 1e-12


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an Arrow column of equally long lists."""
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten(), float).reshape(len(flat), -1)


def keys(col: pa.ChunkedArray) -> np.ndarray:
    """An Arrow column of keys, none null."""
    return np.array(col.to_pylist())


def block_rows(n: int, least: int, most: int) -> int:
    """Rows of a block for ``n`` rows in all."""
    return max(least, min(most, -(-n // BLOCKS)))


def in_blocks(rows: DataFrame, key: str, more: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Staged ``k``, ``v``, ``block`` and ``more`` columns of the rows with a key, and the number of blocks."""
    data = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col("v").cast("array<double>").alias("v"), *more)
    n = data.count()
    blocks = max(1, -(-n // block_rows(n, BLOCK_ROWS, MOST_ROWS)))
    return stage(data.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")), "blocks"), blocks


def each_pair(data: DataFrame, blocks: int, more: Sequence[str] = ()) -> DataFrame:
    """Every block beside itself and each other one: ``p`` <= ``q``, and whether a row is of the ``second`` one."""
    to = data.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return to.select("k", "v", *more, F.least("block", "j").alias("p"), F.greatest("block", "j").alias("q"), (F.col("block") > F.col("j")).alias("second"))


def _squares(x: np.ndarray, y: np.ndarray, y_sq: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + y_sq - 2 * (x @ y.T), 0)


def add_distances(sums: np.ndarray, own: np.ndarray, v: np.ndarray, member: np.ndarray) -> None:
    """Add to ``sums`` the Euclidean distances of the rows of ``own`` to those of ``v``, times ``member``.

    Squared lengths are two columns more, so that one product gives the squared distances; tiles are small enough to stay in a processor's
    cache, and are worked on in place. Those too small for products to tell are computed again.
    """
    left = np.concatenate([own, (own * own).sum(1)[:, None], np.ones((len(own), 1))], 1)
    rows = max(1, TILE_ROWS // STREAM_TILES)
    for b in range(0, len(v), TILE_ROWS):
        part, of = v[b : b + TILE_ROWS], member[b : b + TILE_ROWS]
        lengths = (part * part).sum(1)
        right, least = np.concatenate([-2 * part.T, np.ones((1, len(part))), lengths[None]]), 1e-6 * (1 + lengths.max(initial=0))
        tile = np.empty((rows, len(part)))
        for a in range(0, len(own), rows):
            d = tile[: len(own) - a]
            np.matmul(left[a : a + rows], right, out=d)
            if d.min() < least:
                i, j = np.nonzero(d < least)
                for e in range(0, len(i), 1 << 14):
                    x, y = i[e : e + (1 << 14)], j[e : e + (1 << 14)]
                    d[x, y] = ((own[a + x] - part[y]) ** 2).sum(-1)
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            sums[a : a + rows] += d @ of


def stream_blocks(n: int, width: int) -> int:
    """Blocks for ``n`` rows of ``width`` numbers each; few rows are not parted."""
    return max(1, min(STREAM_BLOCKS, n // (TILE_ROWS // 2)), -(-n * width // MOST_CELLS))


def past_blocks(data: DataFrame, more: Sequence[str], groups: int, members: Callable[[pa.RecordBatch], np.ndarray], done: Callable[[np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``done`` makes of the groups of each block's rows and their sums of distances to the rows of each of ``groups`` groups.

    ``data`` is staged: ``k``, ``v`` and ``more`` columns, from which ``members`` takes the groups of a batch's rows (several each, -1 for
    none). A task holds one block; the rows of all others are sent past it and are forgotten, so what is shuffled is ``STREAM_BLOCKS``
    times the rows, and nothing for pairs or sums.
    """
    n, dims = data.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks, add = stream_blocks(n, (dims or 0) + groups), add_distances

    def one_of(at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), groups))
        r, j = np.nonzero(at >= 0)
        out[r, at[r, j]] = 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, own, at, sums = None, [], None, None, None

        def settle() -> None:
            """The block's own rows are all there: they are compared with each other."""
            nonlocal own, at, sums, held
            own, at = (np.concatenate(z) for z in zip(*held, strict=True))
            sums, held = np.zeros((len(own), groups)), []
            add(sums, own, own, one_of(at))

        for batch in batches:
            p, second = np.asarray(batch.column("p")), batch.column("second").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((p[1:] != p[:-1]) | (second[1:] != second[:-1])) + 1 if len(p) else []
            for a, b in zip([0, *edges], [*edges, len(p)], strict=True) if len(p) else ():
                t = batch.slice(a, b - a)
                v, group = matrix(t.column("v")), members(t)
                if p[a] != block:
                    if block is not None and (own is not None or held):
                        if own is None:
                            settle()
                        yield done(at, sums)
                    block, held, own = p[a], [], None
                if not second[a]:
                    held.append((v, group))
                elif own is not None or held:  # a block that no row fell to has nothing to compare
                    if own is None:
                        settle()
                    add(sums, own, v, one_of(group))
        if own is not None or held:
            if own is None:
                settle()
            yield done(at, sums)

    block = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    to = data.select("v", *more, block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("p"))
    sent = to.select("v", *more, "p", (F.col("block") != F.col("p")).alias("second")).repartitionById(blocks, F.col("p"))
    return sent.sortWithinPartitions("p", "second").mapInArrow(run, schema)


def _nearest(x: np.ndarray, y: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``y`` of the ``k`` nearest vectors of each row of ``x``, not itself, and their distances."""
    at, dist, y_sq, k = [], [], (y * y).sum(1), min(k, len(y) - same)
    more = min(len(y), k + 4)  # some beyond, as the products are rounded
    for a in range(0, len(x) if k > 0 else 0, TILE_ROWS):
        part = x[a : a + TILE_ROWS]
        sq = _squares(part, y, y_sq)
        if same:
            sq[np.arange(len(part)), np.arange(a, a + len(part))] = np.inf
        near = np.argpartition(sq, more - 1, axis=1)[:, :more] if more < len(y) else np.tile(np.arange(len(y)), (len(part), 1))
        exact = np.sqrt(((part[:, None, :] - y[near]) ** 2).sum(-1))
        if same:
            exact[near == np.arange(a, a + len(part))[:, None]] = np.inf
        order = np.argsort(exact, axis=1, kind="stable")[:, :k]
        at.append(np.take_along_axis(near, order, 1))
        dist.append(np.take_along_axis(exact, order, 1))
    return (np.concatenate(at), np.concatenate(dist)) if at else (np.empty((len(x), 0), int), np.empty((len(x), 0)))


def nearest_rows(data: DataFrame, blocks: int, n: int) -> DataFrame:
    """The ``n`` nearest other rows (fewer, if there are fewer) of each row: ``k``, ``near`` (``array<struct<d, k>>``, nearest first)."""
    kind = data.schema["k"].dataType.simpleString()

    def compare(t: pa.Table) -> pa.Table:
        second, k, v = np.asarray(t["second"]), keys(t["k"]), matrix(t["v"])
        same = t["p"][0].as_py() == t["q"][0].as_py()
        x, y = (np.arange(len(k)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        out_k, out_near = [], []
        for a, b in ((x, y),) if same else ((x, y), (y, x)):
            at, dist = _nearest(v[a], v[b], n, same)
            names = k[b][at].tolist() if len(b) else [[]] * len(a)
            out_k += k[a].tolist()
            out_near += [[{"d": d, "k": m} for d, m in zip(ds, ms, strict=True)] for ds, ms in zip(dist.tolist(), names, strict=True)]
        return pa.table({"k": pa.array(out_k, t["k"].type), "near": pa.array(out_near, pa.list_(pa.struct([("d", pa.float64()), ("k", t["k"].type)])))})

    found = each_pair(data, blocks).groupBy("p", "q").applyInArrow(compare, f"k {kind}, near array<struct<d:double,k:{kind}>>")
    return found.groupBy("k").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, n).alias("near"))


def nearest_of_others(asked: DataFrame, data: DataFrame, blocks: int) -> DataFrame:
    """For each row of ``asked`` the nearest row of ``data`` of another group: ``a``, ``b``, ``w``.

    Both have ``k``, ``v``, ``core``, ``comp`` (``data`` also ``block``); ``w`` is the mutual reachability: the largest of the distance and
    both ``core`` distances. Ties go to the smaller key.
    """
    kind = data.schema["k"].dataType.simpleString()
    n = asked.count()
    chunks = max(1, -(-n // block_rows(n, BLOCK_ROWS, MOST_ROWS)))

    def compare(t: pa.Table) -> pa.Table:
        second, k, v, core = np.asarray(t["second"]), keys(t["k"]), matrix(t["v"]), np.asarray(t["core"], float)
        _, comp = np.unique(keys(t["comp"]), return_inverse=True)
        x, y = np.flatnonzero(~second), np.flatnonzero(second)
        y = y[np.argsort(k[y], kind="stable")]
        v_y, y_sq, rows = v[y], (v[y] * v[y]).sum(1), []
        slack = ROUNDING * (1 + (v * v).sum(1).max(initial=0))
        for a in range(0, len(x) if len(y) else 0, TILE_ROWS):
            own = x[a : a + TILE_ROWS]
            sq = np.maximum(_squares(v[own], v_y, y_sq), np.maximum(core[own][:, None], core[y]) ** 2)
            sq[comp[own][:, None] == comp[y]] = np.inf
            least = sq.min(1, keepdims=True)
            r, c = np.nonzero((sq <= least + slack) & np.isfinite(sq))
            w = np.maximum(np.sqrt(((v[own[r]] - v_y[c]) ** 2).sum(-1)), np.maximum(core[own[r]], core[y[c]]))
            order = np.lexsort((c, w, r))
            first = order[np.r_[True, r[order][1:] != r[order][:-1]]] if len(r) else order
            rows += zip(k[own[r[first]]].tolist(), k[y[c[first]]].tolist(), w[first].tolist(), strict=True)
        a, b, w = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"a": pa.array(a, t["k"].type), "b": pa.array(b, t["k"].type), "w": pa.array(w, pa.float64())})

    cols = ["k", "v", "core", "comp"]
    left = asked.select(*cols, F.pmod(F.xxhash64("k"), F.lit(chunks)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q"), F.lit(False).alias("second"))
    right = data.select(*cols, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("p"), F.col("block").alias("q"), F.lit(True).alias("second"))
    found = left.unionByName(right).groupBy("p", "q").applyInArrow(compare, f"a {kind}, b {kind}, w double")
    return found.groupBy("a").agg(F.min(F.struct("w", "b")).alias("m")).select("a", "m.b", "m.w")
