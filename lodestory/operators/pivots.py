"""Vectors of a time bucket in blocks around pivots, and the pairs of blocks that can hold near pairs.

A crowded bucket has pivots of its own, one for about BLOCK_ROWS vectors. Every vector goes to its
nearest pivot, and a pivot's vectors are cut into shells by their angle to it. Angles obey the triangle
inequality, so two blocks whose pivots and shells prove that all their vectors are further apart
than the limit (or, for the farthest pair, nearer than one already known) never meet. What is left
meets exactly; nothing is approximated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestory.storage import cut

#: Vectors of a block about; pivots of a bucket and shells of a pivot at most.
BLOCK_ROWS, PIVOTS, SHELLS = 2048, 256, 8
#: Rounding of angles.
SLACK = 1e-6


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(col.chunks).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def fold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row products summed from the first place on, so that equal vectors give equal sums."""
    out = np.zeros(len(x))
    for p in range(x.shape[1]):
        out += x[:, p] * y[:, p]
    return out


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]


def angles(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Angles between the rows of v and of w."""
    return np.arccos(np.clip(unit(v) @ unit(w).T, -1, 1))


def choose_pivots(rows: DataFrame) -> DataFrame:
    """_b, _cell, pivot: of each bucket one vector for every BLOCK_ROWS, chosen by a hash of the id."""
    size = rows.groupBy("_b").agg(F.least(F.lit(PIVOTS), F.ceil(F.count("*") / BLOCK_ROWS)).cast("int").alias("_n"))
    line = Window.partitionBy("_b").orderBy(F.xxhash64("id", F.lit(3)), "id")
    first = rows.select("_b", "id", "vector").withColumn("_cell", F.row_number().over(line)).where(F.col("_cell") <= PIVOTS).withColumn("_cell", F.col("_cell") - 1)
    return first.join(size, "_b").where("_cell < _n").select("_b", "_cell", F.col("vector").alias("pivot"), "_n")


def place(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Rows with length, in blocks: adds _cell and _angle (to that pivot), _shell and _part. A bucket's rows are dealt
    into as many groups as it has pivots; each group gets all the pivots (of the bucket or, if it
    has none, no place: nothing can be near)."""
    chunks = pivots.select(*[F.col(c).alias(c) for c in ("_b", "_cell", "pivot")], F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_chunk"))
    counts = pivots.select("_b", "_n").distinct()
    dealt = rows.join(counts, "_b").withColumn("_chunk", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).drop("_n")
    names, kinds = rows.columns, dict(rows.dtypes)

    def near(x: pa.Table, y: pa.Table) -> pa.Table:
        x = x.select(names)
        if not len(x) or not len(y):
            return x.slice(0, 0).append_column("_cell", pa.array([], pa.int32())).append_column("_angle", pa.array([], pa.float64()))
        v = matrix(x["vector"])
        long = np.sqrt(fold(v, v)) >= 1e-9
        x, a = x.filter(pa.array(long)), angles(v[long], matrix(y["pivot"]))
        at = a.argmin(1)
        return x.append_column("_cell", y["_cell"].take(pa.array(at)).combine_chunks().cast(pa.int32())).append_column("_angle", pa.array(a[np.arange(len(at)), at]))

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", _cell int, _angle double"
    found = cut(dealt.groupBy("_b", "_chunk").cogroup(chunks.groupBy("_b", "_chunk")).applyInArrow(near, schema))
    # shells of a crowded cell: by quantiles of the angle; equal angles stay together and are dealt into parts
    cuts = found.groupBy("_b", "_cell").agg(F.count("*").alias("_n"), F.percentile_approx("_angle", [k / SHELLS for k in range(1, SHELLS)], 1000).alias("_cuts"))
    cuts = cuts.withColumn("_cuts", F.when(F.col("_n") > BLOCK_ROWS, F.col("_cuts")).otherwise(F.array().cast("array<double>"))).drop("_n")
    shell = F.size(F.filter("_cuts", lambda c: c < F.col("_angle")))
    shells = found.join(cuts, ["_b", "_cell"]).withColumn("_shell", shell.cast("int")).drop("_cuts")
    parts = shells.groupBy("_b", "_cell", "_shell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_parts"))
    return cut(shells.join(parts, ["_b", "_cell", "_shell"]).withColumn("_part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("_parts")).cast("int")))


def blocks(placed: DataFrame, pivots: DataFrame, limit: str | None = None) -> DataFrame:
    """A row per block: its key, parts, rows, least and largest angle, pivot, and the largest limit of its rows."""
    most = [] if limit is None else [F.max(limit).alias("limit")]
    stats = placed.groupBy("_b", "_cell", "_shell").agg(F.first("_parts").alias("_parts"), F.count("*").alias("rows"), F.min("_angle").alias("lo"), F.max("_angle").alias("hi"), *most)
    return stats.join(pivots.select("_b", "_cell", "pivot"), ["_b", "_cell"])


def block_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of blocks of the same and of adjacent buckets: keys of both, rows of both, parts of both and
    whether any of their vectors can be within the left block's limit (a cosine distance)."""
    a = left.withColumn("_b2", F.explode(F.array(*[F.col("_b") + o for o in (-1, 0, 1)])))
    b = right.select("_b", "_cell", "_shell", "_parts", "rows", "lo", "hi", "pivot").withColumnRenamed("_b", "_b2").withColumn("_b", F.explode(F.array(*[F.col("_b2") + o for o in (-1, 0, 1)])))

    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both sides may be one frame

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        i = j = np.zeros(0, np.int64)
        can = np.zeros(0, bool)
        if len(x) and len(y):
            d = angles(matrix(x["pivot"]), matrix(y["pivot"]))
            lo, hi, lo2, hi2 = x["lo"].to_numpy()[:, None], x["hi"].to_numpy()[:, None], y["lo"].to_numpy()[None], y["hi"].to_numpy()[None]
            least = np.maximum(d - hi - hi2, np.maximum(lo - d - hi2, lo2 - d - hi))
            limit = np.arccos(np.clip(1 - x["limit"].to_numpy(), -1, 1))[:, None]
            i, j = np.divmod(np.arange(least.size), len(y))
            can = (least <= limit + SLACK).ravel()
        at, at2 = pa.array(i), pa.array(j)
        cols = {c: x[c].take(at) for c in ("_b", "_cell", "_shell", "_parts", "rows")} | {f"{c}2": y[c].take(at2) for c in ("_b2", "_cell", "_shell", "_parts", "rows")}
        cols["_b2"] = cols.pop("_b22")
        return pa.table(cols | {"can": pa.array(can)}).select(["_b", "_cell", "_shell", "_parts", "rows", "_b2", "_cell2", "_shell2", "_parts2", "rows2", "can"])

    schema = "_b long, _cell int, _shell int, _parts int, rows long, _b2 long, _cell2 int, _shell2 int, _parts2 int, rows2 long, can boolean"
    return a.groupBy("_b", "_b2").cogroup(b.groupBy("_b", "_b2")).applyInArrow(meet, schema)


def far_pairs(left: DataFrame, kind: str) -> DataFrame:
    """Pairs of blocks of one bucket (of type `kind`), each once: keys, rows and parts of both, and whether any of their
    vectors can be as far apart as the bucket's `floor`, an angle. A bucket has PIVOTS * SHELLS blocks at most."""

    def meet(x: pa.Table) -> pa.Table:
        d = angles(matrix(x["pivot"]), matrix(x["pivot"]))
        i, j = np.triu_indices(len(x))
        hi = x["hi"].to_numpy()
        can = d[i, j] + hi[i] + hi[j] >= x["floor"].to_numpy()[i] - SLACK
        at, at2 = pa.array(i), pa.array(j)
        names = ["_b", "_cell", "_shell", "_parts", "rows"]
        return pa.table({c: x[c].take(at) for c in names} | {f"{c}2": x[c].take(at2) for c in names} | {"can": pa.array(can)})

    one = f"_b {kind}, _cell int, _shell int, _parts int, rows long"
    return left.groupBy("_b").applyInArrow(meet, f"{one}, _b2 {kind}, _cell2 int, _shell2 int, _parts2 int, rows2 long, can boolean")


def visited_share(pairs: DataFrame) -> float:
    """Of all pairs of vectors in the buckets that `pairs` compares, the share whose blocks meet."""
    n = F.col("rows") * F.col("rows2")
    every, met = pairs.agg(F.sum(n), F.sum(F.when(F.col("can"), n).otherwise(0))).first()
    return met / every if every else 0.0


def dealt(placed: DataFrame, placed2: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides, each row once for every block (and part of it) that its own block meets, with
    the columns that name a meeting."""
    some = cut(pairs.where("can").drop("rows", "rows2", "can"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one, two = ["_b", "_cell", "_shell"], ["_b2", "_cell2", "_shell2"]
    a = placed.drop("_angle", "_parts").join(some, one).withColumn("_part2", every("_parts2")).drop("_parts", "_parts2")
    b = placed2.drop("_angle", "_parts").withColumnsRenamed(dict(zip([*one, "_part"], [*two, "_part2"], strict=True))).join(some, two).withColumn("_part", every("_parts")).drop("_parts", "_parts2")
    return a, b, [*one, "_part", *two, "_part2"]
