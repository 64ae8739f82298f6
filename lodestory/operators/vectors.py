"""Vector neighbours in time, centroids, merging and the greedy story assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestory.operators import meetings, pivots
from lodestory.operators.graph import connected_components
from lodestory.operators.pivots import fold, matrix, unit
from lodestory.operators.slots import assign_in_slots
from lodestory.shipping import ship
from lodestory.storage import cut

#: Different vectors of a story that are compared in one group; larger stories go into blocks.
BLOCK_ROWS = 2048


def time_pairs(left: DataFrame, right: DataFrame, hours: int, keep: list[str], *, below: str | float, k: int | None = None) -> DataFrame:
    """id, id_2, d, and `keep` of both sides (id, t micros, vector, ...) for rows at most `hours` apart with different
    ids whose cosine distance is under `below` (a number, or a column of the left side); with k,
    at least the k nearest of each left row.

    Time is cut into buckets of that width; a bucket meets itself and its neighbours, in groups of
    rows (see `meetings`). Pairs under the limit are all that leaves a task. Vectors without length have no distance.
    """
    ship(left.sparkSession)
    width = hours * 3_600_000_000
    bucket = F.floor(F.col("t") / width)
    a = cut(left.select("id", "t", "vector", (F.lit(float(below)) if isinstance(below, (int, float)) else F.col(below)).cast("double").alias("_below"), *keep, bucket.alias("_b")))
    b = a.drop("_below") if right is left else cut(right.select("id", "t", "vector", *keep, bucket.alias("_b")))
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both sides may be one frame
    kinds = dict(left.dtypes)
    schema = f"id {kinds['id']}, id_2 {kinds['id']}, d double" + "".join(f", {c} {kinds[c]}, {c}_2 {kinds[c]}" for c in keep)
    return meetings.near_pairs(a, b, width, keep, schema, k)


def timed(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("t", F.unix_micros("published_at"))


def knn_window(vectors: DataFrame, threshold: Column, *, hours: int = 48, k: int = 10, among: DataFrame | None = None) -> DataFrame:
    """id, other, d, rank: for each article the k nearest others (of `among`, or of the same table)
    within the time window whose cosine distance is under the article's own threshold."""
    v = timed(vectors).withColumn("_thr", threshold).select("id", "t", "vector", "_thr")
    near = time_pairs(v, v if among is None else timed(among), hours, [], below="_thr", k=k)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "id_2"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("id", F.col("id_2").alias("other"), "d", "rank")


def centroids(vectors: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Mean vector per key, by position: partial sums before the shuffle, whatever a story's size."""
    long = vectors.where(F.col(key).isNotNull()).select(key, F.posexplode("vector").alias("p", "x"))
    mean = long.groupBy(key, "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("vector"))


def story_points(vectors: DataFrame, paper_prefix: str) -> DataFrame:
    """id, t, vector, paper, size of each story: centroid, first time, strict majority of papers."""
    meta = vectors.where("cluster_id is not null").groupBy("cluster_id").agg(F.min(F.unix_micros("published_at")).alias("t"), F.count("*").alias("size"), (F.count_if(F.col("source_name").startswith(paper_prefix)) * 2 > F.count("*")).alias("paper"))
    return centroids(vectors).join(meta, "cluster_id").withColumnRenamed("cluster_id", "id")


def close_pairs(points: DataFrame, *, news: float, paper: float, hours: int = 48) -> DataFrame:
    """a < b, d: stories in the window under the threshold, which is stricter for two paper stories."""
    pairs = time_pairs(points, points, hours, ["paper"], below=max(news, paper)).where("id < id_2")
    threshold = F.when(F.col("paper") & F.col("paper_2"), paper).otherwise(news)
    return pairs.where(F.col("d") < threshold).select(F.col("id").alias("a"), F.col("id_2").alias("b"), "d")


def ambiguous_pairs(points: DataFrame, *, low: float, high: float, hours: int = 48, most: int = 60) -> DataFrame:
    """The closest pairs in [low, high) without papers, for an outside judge."""
    news = points.where(~F.col("paper"))
    pairs = time_pairs(news, news, hours, [], below=high).where("id < id_2")
    band = pairs.where(F.col("d") >= low).select(F.col("id").alias("a"), F.col("id_2").alias("b"), "d")
    return band.orderBy("d", "a", "b").limit(most)


def merge_with_verdicts(points: DataFrame, close: DataFrame, pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """old, new: stories merged along the close pairs and along the ambiguous pairs (a, b) that an outside judge
    found the same; a pair without a verdict merges nothing."""
    same = apply_verdicts(pairs, verdicts).where("same")
    return merge_stories(points, close.select("a", "b").unionByName(same.select("a", "b")))


def apply_verdicts(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Judged pairs; without a verdict they are not the same."""
    return pairs.join(verdicts, ["a", "b"], "left").withColumn("same", F.coalesce("same", F.lit(False)))


def merge_stories(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """old, new: every story's name after transitive merging; the largest absorbs, the earliest of
    equals, then the smallest id."""
    groups = connected_components(pairs)
    named = points.select("id", "t", "size").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    head = named.groupBy("label").agg(F.min_by("id", F.struct(-F.col("size"), "t", "id")).alias("new"))
    return named.join(head, "label").select(F.col("id").alias("old"), "new")


def greedy_cluster(vectors: DataFrame, threshold: Column, *, hours: int = 48, k: int = 10) -> DataFrame:
    """id, story: oldest first, each article joins the first story among its nearest neighbours' whose
    centroid is under the article's threshold, or starts one (named by its first member)."""
    none = vectors.withColumn("story", F.lit(None).cast("string"))
    return assign_stories(none, threshold, hours=hours, k=k).withColumn("story", F.col("story").cast("long"))


def assign_stories(vectors: DataFrame, threshold: Column, *, hours: int = 48, k: int = 10) -> DataFrame:
    """id, story of the articles whose `story` is null, by the greedy rule; those that have one keep it,
    and their stories, with the centroid of all their members, may be joined.

    Articles are settled slot by slot of time (see `slots`), so no group grows with a component of
    articles that hang together. New stories are named by the id of their first member.
    """
    ship(vectors.sparkSession)
    fresh = vectors.where("story is null").drop("story")
    near = knn_window(fresh, threshold, hours=hours, k=k, among=vectors)
    homes = vectors.select(F.col("id").alias("other"), F.unix_micros("published_at").alias("u"), "story")
    lists = near.join(homes, "other").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other", "u", "story"))), lambda s: F.struct(s["other"].alias("other"), s["u"].alias("u"), s["story"].alias("story"))).alias("near"))
    rows = timed(fresh).select("id", "t", threshold.cast("double").alias("thr"), F.transform("vector", lambda v: v.cast("double")).alias("vector")).join(lists, "id", "left")
    rows = cut(rows.repartitionByRange("t", "id").sortWithinPartitions("t", "id"))
    met = rows.select(F.explode("near.story").alias("story")).where("story is not null").distinct()
    stories = None
    if met.limit(1).count():  # the sum of all members of each story that may be joined
        kept = vectors.join(met, "story", "left_semi")
        size = kept.groupBy("story").agg(F.count("*").alias("n"))
        stories = cut(centroids(kept, "story").join(size, "story").select("story", F.transform("vector", lambda v: v * F.col("n")).alias("vector")))
    return assign_in_slots(rows, stories, hours * 3_600_000_000)


def farthest(x: pa.Table, y: pa.Table) -> float:
    """The largest cosine distance between a vector of x and one of y, all of them with length."""
    v, w = matrix(x["vector"]), matrix(y["vector"])
    n, m = np.sqrt(fold(v, v)), np.sqrt(fold(w, w))
    rough = (v / n[:, None]) @ (w / m[:, None]).T
    i, j = np.nonzero(rough <= rough.min() + 1e-9)
    return float((1 - fold(v[i], w[j]) / (n[i] * m[j])).max())


def intra_max(vectors: DataFrame, key: str = "cluster_id") -> DataFrame:
    """The largest distance between two members of each story of two or more.

    Equal vectors of a story are taken once. A story of at most BLOCK_ROWS of them is one group; larger
    ones are searched by branch and bound (`crowded_max`). Members without length (null, zero or
    non-finite vectors) have no distance; a story with fewer than two others has a null.
    """
    ship(vectors.sparkSession)
    plain = F.transform("vector", lambda e: e.cast("double"))
    v = vectors.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_b"), plain.alias("vector")).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, e: s + e * e))
    v = cut(v.withColumn("norm", norm).withColumn("long", F.coalesce((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False))))
    sizes = cut(v.groupBy("_b").agg(F.sum("n").alias("members"), F.sum(F.when(F.col("long"), F.col("n")).otherwise(0)).alias("measured"), F.count_if("long").alias("rows")))
    kind = dict(v.dtypes)["_b"]
    rows = v.where("long").join(sizes.select("_b", "rows"), "_b")
    few = rows.where(F.col("rows") <= BLOCK_ROWS).select("_b", "vector")
    found = few.groupBy("_b").applyInArrow(lambda x: pa.table({"_b": x["_b"][:1], "max_d": pa.array([farthest(x, x)], pa.float64())}), f"_b {kind}, max_d double")
    if sizes.where(F.col("rows") > BLOCK_ROWS).limit(1).count():
        scale = F.pow(F.lit(2.0), F.floor(F.log2("norm")))  # a power of two changes no distance by a bit
        many = rows.where(F.col("rows") > BLOCK_ROWS).select("_b", "id", F.transform("vector", lambda e: e / scale).alias("vector"))
        found = found.unionByName(crowded_max(cut(many)))
    some = sizes.where("members > 1").join(found, "_b", "left")
    return some.select(F.col("_b").alias(key), F.when(F.col("measured") > 1, F.col("max_d")).alias("max_d"))


def far_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (_b, id, vector) that can be an end of their story's farthest pair, in blocks, and the
    pairs of blocks with those that can hold one.

    Two sweeps give a pair to beat: the member p farthest from the centroid, and the one farthest from
    p, at an angle L. A member whose angle to the centroid, added to the largest such angle, stays under L
    is no end; nor do two blocks hold both ends whose pivots' angle and radii stay under L together.
    """
    kind = dict(rows.dtypes)["_b"]

    def to_point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            if len(t):
                cos = np.einsum("ij,ij->i", unit(matrix(t["vector"])), unit(matrix(t["point"])))
                yield pa.RecordBatch.from_arrays([b.column("_b"), b.column("id"), b.column("vector"), pa.array(np.arccos(np.clip(cos, -1, 1)))], ["_b", "id", "vector", "angle"])

    def sweep(points: DataFrame) -> DataFrame:
        seen = rows.select("_b", "id", "vector").join(points, "_b").select("_b", "id", "vector", "point")
        return seen.mapInArrow(to_point, f"_b {kind}, id {dict(rows.dtypes)['id']}, vector array<double>, angle double")

    out = cut(sweep(centroids(rows, "_b").withColumnRenamed("vector", "point")))
    far = cut(out.groupBy("_b").agg(F.max("angle").alias("radius"), F.max_by("vector", F.struct("angle", "id")).alias("point")))
    floor = cut(sweep(far.select("_b", "point")).groupBy("_b").agg(F.max("angle").alias("floor")))
    bounds = far.select("_b", "radius").join(floor, "_b")
    ends = cut(out.join(bounds, "_b").where(F.col("angle") + F.col("radius") >= F.col("floor") - pivots.SLACK).select("_b", "id", "vector"))
    centres = cut(pivots.choose_pivots(ends))
    placed = pivots.place(ends, centres)
    return placed, cut(pivots.far_pairs(pivots.blocks(placed, centres).join(floor, "_b"), kind))


def crowded_max(rows: DataFrame) -> DataFrame:
    """_b, max_d: the largest distance within each story, from the pairs of blocks that can hold it."""
    placed, pairs = far_blocks(rows)
    a, b, keys = pivots.dealt(placed, placed, pairs)
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both sides are one frame
    kind = dict(rows.dtypes)["_b"]

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return pa.table({"_b": x["_b"][:0], "max_d": pa.array([], pa.float64())})
        return pa.table({"_b": x["_b"][:1], "max_d": pa.array([farthest(x, y)], pa.float64())})

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(meet, f"_b {kind}, max_d double").groupBy("_b").agg(F.max("max_d").alias("max_d"))


def missed_merges(vectors: DataFrame, *, threshold: float, hours: int = 48) -> DataFrame:
    """a, b, d: the nearest pair of articles of two different stories, under the threshold, once per
    pair of stories."""
    v = timed(vectors.where("cluster_id is not null")).select("id", "t", "vector", "cluster_id")
    near = time_pairs(v, v, hours, ["cluster_id"], below=threshold).where(F.col("cluster_id") < F.col("cluster_id_2"))
    return near.groupBy(F.col("cluster_id").alias("a"), F.col("cluster_id_2").alias("b")).agg(F.min("d").alias("d"))


def compare_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """old story, members, parts: into how many new stories each old one is split (1: kept whole)."""
    return old.join(new, "id").groupBy("old").agg(F.count("*").alias("members"), F.count_distinct("story").alias("parts"))
