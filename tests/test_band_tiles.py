"""Tiles of a crowded band give all pairs, one after another in an order that files keep in little space."""

import datetime as dt
import glob
import os

from lodestory.plans import all_queries, news
from lodestory.sources.fixtures import Fixtures
from lodestory.storage import scratch

DAY0, SF = dt.datetime(2024, 1, 1), "/root/testdata/sf0.001"
KINDS = "id string, category string, first_published_at timestamp"


def test_tiles_give_the_pairs_of_a_plain_loop(spark, monkeypatch):
    days = [0, 4, 8, 12] + [(7 * k % 200) / 10 for k in range(240)] + [3.999, 30]
    rows = [(f"s{k}", "abc"[k % 3 if k > 3 else 0], DAY0 + dt.timedelta(days=d)) for k, d in enumerate(days)] + [("none", "a", None)]
    monkeypatch.setattr(news, "BAND_ROWS", 8)
    monkeypatch.setattr(news, "BAND_LIST", 3, raising=False)
    monkeypatch.setattr(Fixtures, "clusters", lambda self: spark.createDataFrame(rows, KINDS))
    want = sorted((i, j) for i, c, t in rows for j, d, u in rows if c == d and i != j and t and u and abs(t - u) <= dt.timedelta(days=4))
    assert sorted(map(tuple, all_queries()["C8_join_time_band"](spark, SF).collect())) == want


def test_no_stories_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(Fixtures, "clusters", lambda self: spark.createDataFrame([], KINDS))
    assert not all_queries()["C8_join_time_band"](spark, SF).collect()


def test_pairs_of_a_crowd_take_a_fraction_of_a_byte(spark, monkeypatch):
    n = 2500
    crowd = spark.range(n).selectExpr("concat(id % 10, '-', 7919 * id % 15013) id", "'a' category", "timestamp_seconds(1704067200 + id) first_published_at").repartition(3)
    monkeypatch.setattr(Fixtures, "clusters", lambda self: crowd)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as larger tables join
    try:
        path = scratch(spark)
        all_queries()["C8_join_time_band"](spark, SF).write.parquet(path)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.read.parquet(path).distinct().count() == n * (n - 1)
    assert sum(os.path.getsize(f) for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet")) < 0.4 * n * (n - 1)
