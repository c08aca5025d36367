"""Exact Lloyd rounds on integer vectors: float32 products shortlist centroids, integers decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.plans.staging import discard, stage

#: Largest absolute component: squared distances of 64 such components fit into 64 bits, and so do float32 products of them.
LARGEST = 1 << 27
#: Largest table of centroids that is sent to all tasks, in numbers.
MOST_NUMBERS = 1 << 23
#: Vectors compared at once, and pairs of a vector and a centroid recomputed at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 4096, 1 << 14


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row and the squared distance to it, both exact; ties go to the smaller number.

    A float32 inner product of d terms is off by at most (d + 2) u / (1 - (d + 2) u) times both lengths, whatever the order of its sums,
    u being 2^-24 and two more roundings those of the factors. That gives each |c|^2 - 2 x c an interval; centroids whose
    interval begins beyond the smallest end are out. Where several are left, their distances are computed in 64-bit integers.
    """
    d = x.shape[1]
    gamma = (d + 2) * 2.0**-24 / (1 - (d + 2) * 2.0**-24)
    c_sq = (centroids * centroids).sum(1)
    c32, c_len = centroids.astype(np.float32), np.sqrt(c_sq.astype(np.float64)) * (1 + 1e-12)
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), ROWS_AT_ONCE):
        rows = x[a : a + ROWS_AT_ONCE]
        dots = (rows.astype(np.float32) @ c32.T).astype(np.float64)
        x_len = np.sqrt((rows.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
        score = c_sq - 2 * dots
        off = 2 * gamma * x_len[:, None] * c_len * (1 + 1e-12) + 2.0**-50 * (c_sq + 2 * np.abs(dots))
        may = score - off <= (score + off).min(1, keepdims=True)
        best = may.argmax(1)  # the first, and the answer where it is the only one
        several = np.flatnonzero(may.sum(1) > 1)
        r, c = np.nonzero(may[several])
        if len(r):
            exact = np.concatenate([((rows[several[r[i : i + PAIRS_AT_ONCE]]] - centroids[c[i : i + PAIRS_AT_ONCE]]) ** 2).sum(1) for i in range(0, len(r), PAIRS_AT_ONCE)])
            order = np.lexsort((c, exact, r))
            first = order[np.r_[True, r[order][1:] != r[order][:-1]]]
            best[several] = c[first]
        out[a : a + ROWS_AT_ONCE] = best
    dist = np.concatenate([((x[a : a + ROWS_AT_ONCE] - centroids[out[a : a + ROWS_AT_ONCE]]) ** 2).sum(1) for a in range(0, len(x), ROWS_AT_ONCE)] or [np.empty(0, np.int64)])
    return out, dist


def integer_vectors(rows: DataFrame, vector: str, dims: int, scale: float) -> Column:
    """``floor(scale * x)`` of each component as ``array<long>``; null unless there are ``dims`` components, none null or non-finite.

    A component beyond ``LARGEST`` is an error, as 64 bits would not hold the distances.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    small = lambda e: F.when(F.abs(e) <= LARGEST, F.floor(e)).otherwise(F.raise_error(F.lit(f"a scaled component exceeds {LARGEST}")).cast("long"))
    return F.when((F.size(x) == dims) & finite, F.transform(x, lambda e: small(e * scale)))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.int64).reshape(len(col), dims)


def _sums(sent: Broadcast, dims: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        n, total = np.zeros(len(c), np.int64), [np.zeros(dims, np.int64)] * len(c)
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            if len(x):
                own, _ = nearest(x, c)
                order = np.argsort(own, kind="stable")
                numbers, starts = np.unique(own[order], return_index=True)
                n += np.bincount(own, minlength=len(c))
                for k, s in zip(numbers.tolist(), np.add.reduceat(x[order], starts, axis=0), strict=True):
                    total[k] = total[k] + s
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array([total[k].tolist() for k in used], pa.list_(pa.int64()))], ["cluster", "n", "s"])

    return add


def _assigned(sent: Broadcast, dims: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, dist = nearest(_matrix(batch.column(1), dims), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array(dist)], ["id", "cluster", "distance"])

    return assign


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors (``id``, ``v``) with the smallest SHA-256 of the seed and the decimal id, ascending; ties by components."""
    rows = vectors.select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def centroid_clusters(
    rows: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:", dims: int = 64, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Exact k-means rounds on vectors made integer.

    Returns per kept vector: the id, ``cluster``, squared ``distance`` to its centroid, ``cluster_inertia`` and ``inertia`` (distances summed
    over its cluster and over all) and ``centroid`` (``array<long>``). Kept are vectors of ``dims`` components, none null, NaN or
    infinite; their components become ``floor(scale * x)``. The first centroids are :func:`first_centroids`; each round assigns every
    vector to the nearest one (ties: the smaller number) and replaces every centroid that has vectors by the floor of their
    exact mean. Repeated rows count one by one, null ids come last among the first centroids; with fewer than ``k`` vectors there
    are as many centroids; without any, or for an empty table, the result is empty. Other columns are ignored.

    Scale: integer vectors are written once and stay where they are. A round sends ``k`` times ``dims`` numbers to all tasks
    (checked against ``MOST_NUMBERS``) and shuffles one sum per task and centroid; sums over tasks are decimals and cannot overflow.
    """
    spark, c = rows.sparkSession, F.col
    if k * dims > MOST_NUMBERS:
        raise ValueError(f"{k} centroids of {dims} numbers are more than {MOST_NUMBERS}")
    vectors = stage(rows.select(c(id_col).alias("id"), integer_vectors(rows, vector_col, dims, scale).alias("v")).filter("v IS NOT NULL"), "vectors")
    centroids = first_centroids(vectors, k, seed)
    kind = rows.schema[id_col].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    wide = "decimal(38,0)"
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(_sums(spark.sparkContext.broadcast(centroids), dims), "cluster int, n long, s array<long>")
        parts = sums.select("cluster", "n", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(c("x").cast(wide)).alias("x"))
        for r in parts.collect():  # a row per number of the centroids
            centroids[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
    found = stage(vectors.mapInArrow(_assigned(spark.sparkContext.broadcast(centroids), dims), f"id {kind}, cluster int, distance long"), "assigned")
    discard(vectors)
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(c("distance").cast(wide)).alias("d")).collect()}  # a row per centroid
    total = sum(inertia.values())
    if total >= 1 << 63:
        raise ValueError("the summed distances exceed 64 bits")
    named = spark.createDataFrame([(i, d, total, centroids[i].tolist()) for i, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(named), "cluster").select(c("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
