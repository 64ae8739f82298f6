"""Meetings of left and right rows that are near in time and angle, as a stream.

The rows of a bucket of time are dealt into a few groups; a group of the left side is held by a task, and the groups
of the right side that can be near in time stream past it. So a row moves once for every group that it meets, not once for
every block. Within a meeting the left rows stand in blocks around pivots of their own, and a batch of right rows skips the
blocks that the triangle inequality of angles excludes; what is left is multiplied block by block in single
precision, and what that can't exclude is measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestory.operators import pivots

#: Blocks of a group at most, groups of a crowded bucket at least (for tasks of their own), pivots of a meeting at most.
GROUP_BLOCKS, LEAST_GROUPS, PIVOTS = 32, 4, 64
#: Pairs that are measured at once, and found pairs that are held before they go on.
MEASURED, HELD = 1 << 16, 1 << 20
KEY = ["_b", "_i", "_b2", "_j"]


def groups(rows: int) -> int:
    """How many groups a bucket of so many rows is dealt into."""
    return max(-(-rows // (GROUP_BLOCKS * pivots.BLOCK_ROWS)), min(LEAST_GROUPS, -(-rows // pivots.BLOCK_ROWS)))


def dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, int]:
    """All rows (of both sides, with their buckets in _b) once for each meeting: its KEY, _right, and the rows' columns; and
    the number of meetings. The driver sees a count for each bucket of time."""
    spark = left.sparkSession
    n, n2 = ({r["_b"]: groups(r["count"]) for r in side.where("_b is not null").groupBy("_b").count().collect()} for side in (left, right))
    meetings = [(b, g, b + o, n2[b + o]) for b, g in n.items() for o in (-1, 0, 1) if b + o in n2]
    plan = spark.createDataFrame(meetings, "_b long, _n long, _b2 long, _n2 long")  # a row for two buckets that meet
    mine = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.join(F.broadcast(plan), "_b").withColumn("_i", mine("_n", 7)).withColumn("_j", every("_n2"))
    b = right.withColumnRenamed("_b", "_b2").join(F.broadcast(plan), "_b2").withColumn("_j", mine("_n2", 11)).withColumn("_i", every("_n"))
    columns = [c for c in left.columns if c not in KEY]
    a = a.select(*KEY, F.lit(False).alias("_right"), *columns)
    b = b.select(*KEY, F.lit(True).alias("_right"), *[F.col(c) if c in right.columns else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns])
    return a.unionByName(b), sum(g * g2 for _, g, _, g2 in meetings)


def near_pairs(left: DataFrame, right: DataFrame, width: int, keep: list[str], schema: str, k: int | None) -> DataFrame:
    """id, id_2, d and `keep` of both sides for rows (id, t, vector, keep, left ones _below, bucket _b) at most `width` apart
    whose distance is under _below; with k, at least the k nearest of each left row."""
    rows, meetings = dealt(left, right)
    parts = max(1, min(meetings, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, side = None, [], None
        for batch in batches:
            names = [*KEY, "_right"]
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if key != (now := tuple(at[:-1, lo].tolist())):
                    if side:
                        yield from side.rest()
                    key, held, side = now, [], None
                run_of = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if not at[-1, lo]:
                    held.append(run_of)
                elif held or side:
                    if not side:
                        side, held = LeftRows(pa.concat_tables(held), width, keep, k), []
                    yield from side.against(run_of)
        if side:
            yield from side.rest()

    ordered = rows.repartition(parts, *KEY).sortWithinPartitions(*KEY, "_right")
    return ordered.mapInArrow(run, schema)


def measurable(x: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The rows whose vectors have a length, their vectors and lengths."""
    v = pivots.matrix(x["vector"])
    n = np.sqrt(pivots.fold(v, v))
    long = (n >= 1e-9) & (n < np.inf)
    return x.filter(pa.array(long)), v[long], n[long]


class LeftRows:
    """The left rows of a meeting, in blocks: those nearest to one pivot, in the order of their angle to it."""

    def __init__(self, x: pa.Table, width: int, keep: list[str], k: int | None):
        x, v, n = measurable(x)
        self.width, self.keep, self.k = width, keep, k
        some = np.unique(np.linspace(0, len(x) - 1, min(PIVOTS, -(-len(x) // pivots.BLOCK_ROWS) * 2), dtype=np.int64)) if len(x) else np.zeros(0, np.int64)
        self.pivots = v[some]
        cell, angle = self.placed(v)
        order = np.lexsort((angle, cell))
        self.x, self.v, self.n = x.take(pa.array(order)).combine_chunks(), v[order], n[order]
        self.u = (self.v / self.n[:, None]).astype(np.float32)
        self.t, self.limit = self.x["t"].to_numpy(), self.x["_below"].to_numpy().copy()
        self.ids = self.x["id"].combine_chunks()
        self.bound = self.limit.copy()  # with k, what a row's next neighbour may be away at most
        cell, angle = cell[order], angle[order]
        edges = np.searchsorted(cell, np.arange(len(some) + 1))
        self.blocks = [(a, min(a + pivots.BLOCK_ROWS, hi)) for lo, hi in zip(edges, edges[1:], strict=False) for a in range(lo, hi, pivots.BLOCK_ROWS)]
        first = np.array([a for a, _ in self.blocks], np.int64)
        self.cell, self.lo, self.hi = cell[first], angle[first], angle[[b - 1 for _, b in self.blocks]] if self.blocks else np.zeros(0)
        self.apart = pivots.angles(self.pivots, self.pivots) if len(some) else np.zeros((0, 0))
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Table]] = []
        self.pairs = 0

    def placed(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector, and the angle to it."""
        if not len(self.pivots):
            return np.zeros(0, np.int64), np.zeros(0)
        cells, out = [], []
        for lo in range(0, len(v), pivots.BLOCK_ROWS):
            a = pivots.angles(v[lo : lo + pivots.BLOCK_ROWS], self.pivots)
            cells.append(a.argmin(1))
            out.append(a[np.arange(len(a)), cells[-1]])
        return (np.concatenate(cells), np.concatenate(out)) if cells else (np.zeros(0, np.int64), np.zeros(0))

    def against(self, y: pa.Table) -> Iterator[pa.RecordBatch]:
        """Takes in right rows; without k, gives the pairs under the limit."""
        y, w, m = measurable(y)
        if not len(y) or not self.blocks:
            return
        cell, angle = self.placed(w)
        order = np.lexsort((angle, cell))
        y, w, m, cell, angle = y.take(pa.array(order)).combine_chunks(), w[order], m[order], cell[order], angle[order]
        u, t, ids = (w / m[:, None]).astype(np.float32), y["t"].to_numpy(), y["id"].combine_chunks()
        start = np.searchsorted(cell, np.arange(len(self.pivots) + 1))
        some = np.flatnonzero(np.diff(start))
        lo, hi = angle[start[some]], angle[start[some + 1] - 1]
        slack = (w.shape[1] + 8) * 2.0**-22  # of single precision, twice
        for b, (first, last) in enumerate(self.blocks):
            bound = self.bound[first:last]
            d = self.apart[self.cell[b], some]
            least = np.maximum(d - self.hi[b] - hi, np.maximum(self.lo[b] - d - hi, lo - d - self.hi[b]))
            can = least <= np.arccos(np.clip(1 - bound.max(), -1, 1)) + pivots.SLACK
            if not can.any():
                continue
            at = np.arange(len(w)) if can.all() else np.concatenate([np.arange(start[c], start[c + 1]) for c in some[can]])
            for at2 in np.split(at, range(pivots.BLOCK_ROWS, len(at), pivots.BLOCK_ROWS)):
                near = self.u[first:last] @ u[at2].T >= (1 - bound - slack).astype(np.float32)[:, None]
                i, j = np.divmod(np.flatnonzero(near), len(at2))
                i, j = i + first, at2[j]
                ok = (np.abs(self.t[i] - t[j]) <= self.width) & pc.not_equal(self.ids.take(pa.array(i)), ids.take(pa.array(j))).to_numpy(zero_copy_only=False)
                i, j = i[ok], j[ok]
                d = np.concatenate([1 - pivots.fold(self.v[p], w[q]) / (self.n[p] * m[q]) for p, q in zip(self.cut(i), self.cut(j), strict=True)])
                ok = (d < self.limit[i]) & (d <= self.bound[i])
                i, j, d = i[ok], j[ok], d[ok]
                if self.k is not None and len(i) > HELD // 8:
                    best = self.nearest(i, d, ids.take(pa.array(j)))
                    i, j, d = i[best], j[best], d[best]
                if len(i):
                    self.found.append((i, d, y.select(["id", *self.keep]).take(pa.array(j))))
                    self.pairs += len(i)
                if self.pairs > HELD:
                    yield from self.passed_on()

    @staticmethod
    def cut(at: np.ndarray) -> list[np.ndarray]:
        return np.split(at, range(MEASURED, len(at), MEASURED))

    def nearest(self, i: np.ndarray, d: np.ndarray, ids: pa.Array) -> np.ndarray:
        """Of pairs, the places of the k nearest of each left row, in order; ties to the smaller id."""
        place = ids.to_numpy() if pa.types.is_integer(ids.type) else pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy()
        order = np.lexsort((place, d, i))
        i = i[order]
        return order[np.arange(len(i)) - np.searchsorted(i, i) < self.k]

    def passed_on(self) -> Iterator[pa.RecordBatch]:
        """Without k, the pairs found so far. With k, they are cut to the k nearest of each row, which bound what may come."""
        i, d, y = (np.concatenate([f[0] for f in self.found]), np.concatenate([f[1] for f in self.found]), pa.concat_tables([f[2] for f in self.found])) if self.found else (np.zeros(0, np.int64), np.zeros(0), None)
        self.found, self.pairs = [], 0
        if self.k is None:
            yield from self.out(i, d, y)
        elif y is not None:
            best = self.nearest(i, d, y["id"].combine_chunks())
            i, d, y = i[best], d[best], y.take(pa.array(best))
            self.found = [(i, d, y)]
            full = np.flatnonzero(np.bincount(i, minlength=len(self.n)) == self.k)
            self.bound[full] = d[np.searchsorted(i, full, "right") - 1]

    def out(self, i: np.ndarray, d: np.ndarray, y: pa.Table | None) -> Iterator[pa.RecordBatch]:
        if y is None:
            return
        x = self.x.select(["id", *self.keep]).take(pa.array(i))
        cols = {"id": x["id"], "id_2": y["id"], "d": pa.array(d)}
        for c in self.keep:
            cols |= {c: x[c], f"{c}_2": y[c]}
        yield from pa.table(cols).combine_chunks().to_batches(max_chunksize=MEASURED)

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What is still held."""
        yield from self.passed_on()
        for i, d, y in self.found:
            yield from self.out(i, d, y)
