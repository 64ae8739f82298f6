"""Clustering around centroids, each vector's nearest found by the threshold algorithm.

The centroids (few, so every task holds them) stand in one sorted list per dimension. From each
vector's own value the lists are walked outward in all dimensions at once; every centroid met is
measured in full. The gaps to the next centroid not yet passed, squared and summed over the
dimensions, bound what is still unseen from below: once that sum is strictly above the best
distance, the search ends, and a tie with a smaller number can't be missed.

All numbers are integers. Sums per centroid and dimension are made in the tasks, then by Spark;
only they (centroids times dimensions) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestory.llm.shared import cut, prepare

#: Largest magnitude of a component after scaling: distances stay within 64 bits.
LIMIT = 1 << 24
#: Vectors that walk together.
WALK_ROWS = 512


def nearest_centroids(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest of the centroids c (the smaller number of
    equals), and how many were measured, for each row of x; 64-bit integers."""
    k, dims = c.shape
    order = np.argsort(c, axis=0, kind="stable")
    far = np.full((1, dims), 4 * LIMIT)  # further off than any two vectors
    value = np.concatenate([-far, np.take_along_axis(c, order, 0), far])
    number = np.concatenate([np.full((1, dims), k), order, np.full((1, dims), k)])
    col = np.arange(dims)
    n = len(x)
    best, who, measured = np.full(n, np.iinfo(np.int64).max), np.full(n, k), np.zeros(n, np.int64)
    up = np.stack([np.searchsorted(value[:, j], x[:, j]) for j in range(dims)], 1) if n else np.zeros((0, dims), np.int64)
    down = up - 1
    seen = np.zeros((n, k + 1), bool)
    live = np.arange(n)
    while len(live):
        v, lo, hi = x[live], down[live], up[live]
        left = v - value[lo, col] <= value[hi, col] - v
        met = np.zeros((len(live), k + 1), bool)
        met[np.arange(len(live))[:, None], number[np.where(left, lo, hi), col]] = True
        i, j = np.nonzero((met & ~seen[live])[:, :k])
        seen[live] |= met
        d = np.full((len(live), k), np.iinfo(np.int64).max)
        d[i, j] = ((v[i] - c[j]) ** 2).sum(1)
        measured[live] += np.bincount(i, minlength=len(live))
        at = d.argmin(1)
        d = d[np.arange(len(live)), at]
        better = (d < best[live]) | ((d == best[live]) & (at < who[live]))
        best[live], who[live] = np.where(better, d, best[live]), np.where(better, at, who[live])
        # a list's end is a sentinel that is met but never passed
        down[live] = lo = np.maximum(np.where(left, lo - 1, lo), 0)
        up[live] = hi = np.minimum(np.where(left, hi, hi + 1), k + 1)
        gap = np.minimum(v - value[lo, col], value[hi, col] - v)
        live = live[((gap * gap).sum(1) <= best[live]) & ~seen[live, :k].all(1)]
    return who, best, measured


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for s in range(0, b.num_rows, WALK_ROWS):
            part = b.slice(s, WALK_ROWS)
            yield part, part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, -1)


def scaled_vectors(vectors: DataFrame, *, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id, q: floor(scale * x) of vectors with `dims` components, none null or non-finite."""
    fit = (F.size(vector_col) == dims) & F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.floor(v.cast("double") * scale)
    fine = lambda v: F.when(F.abs(v.cast("double")) * scale <= LIMIT, whole(v)).otherwise(F.raise_error(F.lit(f"component beyond {LIMIT} after scaling")))
    return vectors.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda v: fine(v).cast("int")).alias("q"))


def cluster_vectors(vectors: DataFrame, *, clusters: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, n_measured.

    Vectors of another length or with null or non-finite components take no part; components become
    floor(scale * x), and those beyond LIMIT fail by name. The first centroids are the vectors
    with the smallest SHA-256 of `seed:id` (a null id counts as empty; ties by components), fewer if
    there are fewer vectors. In each round a centroid becomes its vectors' componentwise
    floor(sum / count); one without vectors stays. Repeated rows count each; no vectors give no rows.
    """
    prepare(vectors.sparkSession)
    points = cut(scaled_vectors(vectors, dims=dims, scale=scale, id_col=id_col, vector_col=vector_col))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = points.orderBy(rank, "q").limit(clusters).select("q").collect()
    c = np.array([r["q"] for r in start], np.int64).reshape(len(start), dims)

    for _ in range(rounds):

        def add(batches: Iterator[pa.RecordBatch], c=c) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(c), np.int64), np.zeros_like(c)
            for _, x in _rows(batches):
                who = nearest_centroids(x, c)[0]
                n += np.bincount(who, minlength=len(c))
                np.add.at(total, who, x)
            k, d = np.nonzero(np.repeat(n[:, None] > 0, dims, 1))
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[k, d]), pa.array(n[k])], ["cluster", "dim", "total", "n"])

        sums = points.mapInArrow(add, "cluster int, dim int, total long, n long").groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        c = c.copy()
        for r in sums:  # centroids times dimensions
            c[r["cluster"], r["dim"]] = r["total"] // r["n"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _rows(batches):
            who, d, n = nearest_centroids(x, c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who.astype(np.int32)), pa.array(d), pa.array(n)], ["id", "cluster", "distance", "n_measured"])

    near = cut(points.mapInArrow(assign, f"id {dict(points.dtypes)['id']}, cluster int, distance long, n_measured long"))
    own = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row per centroid
    inertia = sum(r["cluster_inertia"] for r in own)
    text = [(r["cluster"], r["cluster_inertia"], inertia, hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()) for r in own]
    facts = points.sparkSession.createDataFrame(text, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_measured")
