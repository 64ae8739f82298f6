"""The greedy story rule in supersteps over slots of time.

An article's story depends only on earlier articles among its neighbours and on what has joined
their stories before it. So the articles of a slot, together with the stories that its settled
neighbours belong to, fall into components that don't touch each other; components are dealt into
bins, and each bin is replayed in order in one group. A bin settles its first GROUP_ROWS articles,
the others wait for the next superstep: no group holds more, however articles hang together,
and one component of a great part of the data only takes more supersteps. Where most of a slot has
to wait, its articles hang together: the next slots are a group each, without a search for components,
before a large slot is tried again. Settled articles and the sums of touched stories are written after
each superstep; later ones read those that the time window can still reach.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestory.operators.graph import connected_components
from lodestory.storage import cut, scratch

#: Articles that a group settles in a superstep at most, and groups that a slot is meant to fill.
GROUP_ROWS, SLOT_GROUPS = 32_768, 8


def replay(df: pd.DataFrame) -> pd.DataFrame:
    """Rows of one bin: articles (id, t, thr, vector, near) in order, and stories that may be joined
    (story, vector: the sum of their members). Returns the articles' stories and the touched sums."""
    fixed = df["id"].isna()
    sums = {s: np.asarray(v, np.float64) for s, v in zip(df["story"][fixed], df["vector"][fixed], strict=True)}
    articles = df[~fixed].sort_values(["t", "id"])
    home_of: dict[int, str] = {}
    for i, thr, v, near in zip(articles["id"], articles["thr"], articles["vector"], articles["near"], strict=True):
        i, v, home, tried = int(i), np.asarray(v, np.float64), str(int(i)), set()
        for n in near if near is not None else ():
            s = n["story"] or home_of.get(n["other"])
            if s is None or s in tried:
                continue
            tried.add(s)
            size = np.linalg.norm(sums[s]) * np.linalg.norm(v)
            if size >= 1e-9 and 1 - sums[s] @ v / size < thr:
                home = s
                break
        home_of[i] = home
        sums[home] = sums[home] + v if home in sums else v
    touched = sorted(set(home_of.values()))
    settled = pd.DataFrame({"id": pd.array(list(home_of), "Int64"), "story": list(home_of.values()), "vector": None})
    return pd.concat([settled, pd.DataFrame({"id": pd.array([None] * len(touched), "Int64"), "story": touched, "vector": [sums[s] for s in touched]})])


def assign_in_slots(rows: DataFrame, stories: DataFrame | None, window: int) -> DataFrame:
    """id, story of all articles: rows (id, t, thr, vector, near: their neighbours in order as structs
    of other, u (its time) and story, if it has a fixed one), stories (story, vector: sums of those that may be joined from
    the start), window: how far neighbours are apart at most, in the unit of t.

    Counts per span of time, one per superstep, are all that the driver sees.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["id"]
    schema = f"id {kind}, story string, vector array<double>"
    lo, hi, n = rows.agg(F.min("t"), F.max("t"), F.count("*")).first()
    width = (hi - lo + 1) if n else 1
    left = {0: n} if n else {}  # articles to settle, by span of time
    span = F.floor((F.col("t") - lo) / width)
    if n > GROUP_ROWS:  # about eight spans a group
        width = max(1, math.ceil(width / (8 * n / GROUP_ROWS)))
        span = F.floor((F.col("t") - lo) / width)
        left = {r["b"]: r["count"] for r in rows.groupBy(span.alias("b")).count().collect()}
    pieces: list[tuple[int, str]] = []  # the end of the slot that a piece settled, and its folder
    seen: set[int] = set()  # spans of which some articles are settled
    single, pause = 0, 1  # slots of one group that are still to come, and how many after the next large one that fails
    while left:
        most, size, taken = GROUP_ROWS if single else SLOT_GROUPS * GROUP_ROWS, 0, []
        for b in sorted(left):
            if taken and size + left[b] > most:
                break
            size, taken = size + left[b], [*taken, b]
        since, until = lo + taken[0] * width, lo + (taken[-1] + 1) * width
        done = [p for end, p in pieces if end > since - window]
        settled = spark.read.schema(schema).parquet(*done) if done else None
        slot = rows.where((F.col("t") >= since) & (F.col("t") < until))
        if seen.intersection(taken):
            slot = slot.join(settled.where("id is not null").select("id"), "id", "left_anti")
        near = slot.select("id", "t", F.posexplode("near").alias("rank", "n")).select("id", "t", "rank", "n.other", "n.u", "n.story")
        near = near.where("story is not null or u < t or (u = t and other < id)")
        if settled is not None:
            homes = settled.where("id is not null").select(F.col("id").alias("other"), F.col("story").alias("home"))
            near = near.join(homes, "other", "left").withColumn("story", F.coalesce("story", "home"))
        near = cut(near.select("id", "rank", "other", "story"))
        placed = _binned(slot.drop("near"), near, size)
        lists = near.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other", "story"))), lambda s: F.struct(s["other"].alias("other"), s["story"].alias("story"))).alias("near"))
        group = placed.join(lists, "id", "left").select("bin", "id", "t", "thr", "vector", "near", F.lit(None).cast("string").alias("story"))
        sums = _sums(spark, stories, done, schema)
        if sums is not None:
            wanted = near.where("story is not null").join(placed.select("id", "bin"), "id").select("bin", "story").distinct()
            empty = [F.lit(None).cast(group.schema[c].dataType).alias(c) for c in ("id", "t", "thr")]
            group = group.unionByName(wanted.join(sums, "story").select("bin", *empty, "vector", F.lit(None).cast(group.schema["near"].dataType).alias("near"), "story"))
        path = scratch(spark)
        group.groupBy("bin").applyInPandas(replay, schema).write.parquet(path)
        pieces.append((until, path))
        for b in taken:
            del left[b]
        single = max(0, single - 1)
        if size > GROUP_ROWS:
            rest = slot.join(spark.read.schema(schema).parquet(path).where("id is not null").select("id"), "id", "left_anti")
            waiting = {r["b"]: r["count"] for r in rest.groupBy(span.alias("b")).count().collect()}
            left, seen = left | waiting, seen.union(waiting)
            if 2 * sum(waiting.values()) >= size:
                single, pause = pause, 2 * pause
            else:
                pause = 1
    if not pieces:
        return spark.createDataFrame([], f"id {kind}, story string")
    return spark.read.schema(schema).parquet(*[p for _, p in pieces]).where("id is not null").select("id", "story")


def _binned(slot: DataFrame, near: DataFrame, size: int) -> DataFrame:
    """Adds the bin; of each bin the first GROUP_ROWS articles in order."""
    if size <= GROUP_ROWS:
        return slot.withColumn("bin", F.lit(0))
    node = F.concat(F.lit("a"), "id")
    labels = connected_components(near.select(node.alias("a"), F.coalesce(F.concat(F.lit("s"), "story"), F.concat(F.lit("a"), "other")).alias("b")))
    at = slot.withColumn("node", node).join(labels, "node", "left")
    at = at.withColumn("bin", F.pmod(F.xxhash64(F.coalesce("label", "node")), F.lit(math.ceil(2 * size / GROUP_ROWS))).cast("int"))
    place = F.row_number().over(Window.partitionBy("bin").orderBy("t", "id"))
    return cut(at.withColumn("_place", place).where(F.col("_place") <= GROUP_ROWS).drop("_place", "node", "label"))


def _sums(spark, stories: DataFrame | None, done: list[str], schema: str) -> DataFrame | None:
    """story, vector: the sum of each story as it was last written."""
    parts = [] if stories is None else [stories.select("story", "vector", F.lit(-1).alias("step"))]
    parts += [spark.read.schema(schema).parquet(p).where("id is null").select("story", "vector", F.lit(k).alias("step")) for k, p in enumerate(done)]
    if not parts:
        return None
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("story").agg(F.max_by("vector", "step").alias("vector"))
