"""Approximate nearest neighbours by collision counting on single projections.

Every shard keeps, for each of many random directions, its vectors in the order of their
projections. A query opens a window around its own projection on each direction and widens all
windows step by step (virtual rehashing); a vector that lies in enough windows is verified by
its true distance. Windows stop when they are wide enough, against the k-th distance found,
that a nearer vector would have collided often enough. Shards have a bounded size and every
vector is in one; a shard's arrays are made once and all queries stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestory.llm.shared import prepare, ragged

DIRECTIONS = 96
#: A vector in more windows than this share is verified.
COLLISIONS = 0.39
#: Half a window, in units of the k-th distance, at which the search ends: a vector at that
#: distance then collides two standard deviations more often than the share above.
ENOUGH = 0.64
WIDEN = 1.25
#: Vectors of a shard, about.
SHARD_ROWS = 16384


class SortedProjections:
    """A shard's vectors and their order on every direction."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, directions: int = DIRECTIONS, seed: int = 11):
        self.ids, self.x = ids, x
        self.a = np.random.default_rng(seed).normal(size=(x.shape[1], directions))
        p = x @ self.a
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        line = np.take_along_axis(p.T, self.order, axis=1)
        self.spread = float(np.abs(line).mean())
        # all arrays in one, each moved beyond the one before, so that one search serves all
        self.low, self.high = float(line.min()), float(line.max())
        self.move = np.arange(directions) * 2 * (self.high - self.low + 1)
        self.line = (line + self.move[:, None]).ravel()
        self.flat = self.order.ravel()

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, nearest first, ties to smaller ids."""
        n, m = len(self.x), len(self.move)
        pq = q @ self.a
        mid = np.searchsorted(self.line, np.clip(pq, self.low, self.high) + self.move)
        lo, hi = mid.copy(), mid.copy()
        counts = np.zeros(n, np.int64)
        seen = np.zeros(n, bool)
        seen[self.ids == own] = True
        got, dist = np.zeros(0, np.int64), np.zeros(0)
        half = max(1e-12, 0.3 * self.spread)
        least = COLLISIONS * m
        while True:
            # windows end with their array
            new_lo = np.searchsorted(self.line, np.maximum(pq - half, self.low - 0.5) + self.move)
            new_hi = np.searchsorted(self.line, np.minimum(pq + half, self.high + 0.5) + self.move, "right")
            new_lo, new_hi = np.minimum(new_lo, lo), np.maximum(new_hi, hi)
            starts, lens = np.concatenate([new_lo, hi]), np.concatenate([lo - new_lo, new_hi - hi])
            counts += np.bincount(self.flat[ragged(starts, lens)], minlength=n)
            lo, hi = new_lo, new_hi
            cand = np.flatnonzero((counts > least) & ~seen)
            if len(cand):
                seen[cand] = True
                got = np.concatenate([got, cand])
                dist = np.concatenate([dist, np.sqrt(((self.x[cand] - q) ** 2).sum(1))])
                keep = np.lexsort((self.ids[got], dist))[:k]
                got, dist = got[keep], dist[keep]
            if seen.all() or (len(got) == k and half >= ENOUGH * dist[-1]):
                return self.ids[got], dist
            half *= WIDEN


def nearest_neighbours(vectors: DataFrame, *, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query (id divisible by `every`) the k nearest other vectors by Euclidean distance.

    Returns query_id, rank (from 1), vec_id, score (the distance in double precision), nearest
    first, ties to the smaller id. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows with a null id; vectors of different lengths never
    meet; rows that repeat an id are one candidate (at its smallest distance), and a query's own
    id is none. Fewer candidates than k: all of them. No queries or vectors: no rows.
    """
    prepare(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("d"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    data = rows.select("d", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "id", "v")
    # every query against all rows: each shard gets its vectors first, then all queries
    queries = rows.where(F.col("id") % every == 0).select("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"), "id", "v")
    both = data.unionByName(queries).repartition("d", "shard").sortWithinPartitions("d", "shard", "kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for b in batches:
            d, shard, kind, ids = (c.to_numpy() for c in b.columns[:4])
            new = np.flatnonzero((d[1:] != d[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1
            out: list[tuple] = []
            for lo, hi in zip([0, *new], [*new, len(d)], strict=True):
                if lo == hi:
                    continue
                if now != (d[lo], shard[lo]):
                    now, held, index = (d[lo], shard[lo]), [], None
                x = _matrix(b.column(4).slice(lo, hi - lo), int(d[lo]))
                if kind[lo] == 0:
                    held.append((ids[lo:hi], x))
                    continue
                if held:
                    index, held = SortedProjections(*(np.concatenate(p) for p in zip(*held, strict=True))), []
                for q, vec in zip(ids[lo:hi].tolist(), x, strict=True) if index else ():
                    found, dist = index.search(vec, q, k)
                    out += zip([q] * len(found), found.tolist(), dist.tolist(), strict=True)
            q, v, score = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
