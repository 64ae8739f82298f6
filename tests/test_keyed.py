"""Merges that rewrite only what they touch, and writers at the same time."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from lodestory.sources import keyed, sinks
from lodestory.storage import scratch


def upsert(old, new):
    return sinks.upsert(old, new, "key", overwrite=["v"], keep=[])


def written(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_bytes_follow_the_batch(spark):
    path = scratch(spark)
    t = keyed.KeyedTable(spark, path, "key", 32)
    assert t.read() is None
    assert len(t.merge(spark.range(20000).select(F.col("id").alias("key"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("v")), upsert)) == 32
    before = written(path)
    touched = t.merge(spark.createDataFrame([(5, "new"), (70000, "added")], "key long, v string"), upsert)
    after = {f: n for f, n in written(path).items() if f not in before}
    assert len(touched) <= 2 and sum(after.values()) < 0.15 * sum(before.values())
    rows = t.read()
    assert rows.count() == 20001 and {r["key"] for r in rows.where("v in ('new', 'added')").collect()} == {5, 70000}
    assert len(keyed.KeyedTable(spark, path, "key").versions()) == 2


def test_numbered_batches_are_taken_in_once(spark):
    t = keyed.KeyedTable(spark, scratch(spark), "key", 4)
    row = lambda v: spark.createDataFrame([(1, v)], "key long, v string")
    assert t.merge(row("a"), upsert, number=1) and not t.merge(row("b"), upsert, number=1) and t.merge(row("c"), upsert, number=2)
    assert [tuple(r) for r in t.read().collect()] == [(1, "c")] and not t.merge(row("x").limit(0), upsert, number=3)


def test_writers_at_the_same_time(spark):
    path = scratch(spark)
    keyed.KeyedTable(spark, path, "key", 16).merge(spark.range(100).select(F.col("id").alias("key"), F.lit("old").alias("v")), upsert)
    part = {r["id"]: r["p"] for r in spark.range(100).select("id", F.pmod(F.xxhash64("id"), F.lit(16)).alias("p")).collect()}
    first = next(k for k in range(100))
    other = next(k for k in range(100) if part[k] != part[first])
    same = next(k for k in range(100) if k != first and part[k] == part[first])
    row = lambda k, v: spark.createDataFrame([(k, v)], "key long, v string")

    def between(k):
        """A merge during which another writer merges key k."""

        def combine(old, new):
            keyed.KeyedTable(spark, path, "key", 16).merge(row(k, "theirs"), upsert)
            return upsert(old, new)

        return combine

    keyed.KeyedTable(spark, path, "key", 16).merge(row(first, "mine"), between(other))  # other partitions: both stay
    got = {r["key"]: r["v"] for r in keyed.KeyedTable(spark, path, "key").read().collect()}
    assert (got[first], got[other], len(got)) == ("mine", "theirs", 100)
    with pytest.raises(keyed.Conflict):
        keyed.KeyedTable(spark, path, "key", 16).merge(row(first, "again"), between(same))
    got = {r["key"]: r["v"] for r in keyed.KeyedTable(spark, path, "key").read().collect()}
    assert (got[first], got[same]) == ("mine", "theirs")


def test_one_of_many_claims_succeeds(spark):
    path, won = f"{scratch(spark)}/claim", []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if keyed.create_new(spark, path, str(k)) else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1
    with open(path.removeprefix("file:")) as f:
        assert f.read() == str(won[0])


def test_version_without_content_is_not_seen(spark):
    path = scratch(spark)
    t = keyed.KeyedTable(spark, path, "key", 2)
    t.merge(spark.createDataFrame([(1, "a")], "key long, v string"), upsert)
    keyed.create_new(spark, f"{path}/versions/v{2:020d}.json", "{")  # a writer that died
    assert t.newest()[0] == 1 and t.merge(spark.createDataFrame([(1, "b")], "key long, v string"), upsert)
    assert t.newest()[0] == 3 and t.read().first()["v"] == "b"
