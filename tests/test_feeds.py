"""Feeds written as files and read back."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestory.sources import feeds
from lodestory.sources.scans import scan_feed
from lodestory.storage import scratch

NOW = datetime(2024, 1, 20, 12)
HEAD = ['A & B <i>"new"</i>', "Äpfel\x07 ]]> -- !", None, "x" * 200, "plain"]


@pytest.fixture(scope="module")
def items(spark):
    s = spark.createDataFrame([(f"s{k}", h, 5.0 + k % 2 if k != 4 else 4.0, NOW - timedelta(days=k, seconds=7), k) for k, h in enumerate(HEAD)] + [("old", "old", 9.0, NOW - timedelta(days=8), 0)], "id string, headline string, significance_score double, first_published_at timestamp, best_id long")
    a = spark.createDataFrame([(0, "<p>Tom &amp; Jo</p>\n\tgo", "https://a.example/?x=1&y=2"), (1, None, "u1"), (3, "three", None)], "id long, body_excerpt string, source_url string")
    return feeds.story_items(s, a, F.lit(f"{NOW}").cast("timestamp"), site="https://n.example")


@pytest.mark.parametrize("kind", ["xml", "json"])
def test_items_come_back(spark, items, kind):
    path = feeds.write_feed(items, scratch(spark), kind)
    got = {r["guid"]["_VALUE"]: r for r in feeds.read_feed(spark, path, kind).collect()}
    want = {r["guid"]["_VALUE"]: r for r in items.collect()}
    assert set(got) == set(want) == {"s0", "s1", "s2", "s3"}  # s4 is under the score, old too old
    for k, r in want.items():
        g = got[k]
        assert (g["link"], g["pubDate"], g["day"], g["guid"]["_isPermaLink"]) == (r["link"], r["pubDate"], r["day"], "false")
        assert (g["title"] or None) == (r["title"] or None) and (g["description"] or "").strip() == r["description"].strip()
    assert want["s0"]["link"] == "https://n.example/story/s0/a-b-i-new-i" and want["s2"]["link"] == "https://n.example/story/s2" and want["s3"]["link"].endswith("/" + "x" * 80)
    assert want["s0"]["pubDate"] == "Sat, 20 Jan 2024 11:59:53 GMT"


def test_feed_reader_gives_the_same_rows(spark, items):
    rows = {r["source_url"]: r for r in scan_feed(spark, feeds.write_feed(items, scratch(spark))).collect()}
    r = rows["https://n.example/story/s0/a-b-i-new-i"]
    assert r["title"] == HEAD[0] and r["body_excerpt"] == "Tom & Jo go (Source: https://a.example/?x=1&y=2)" and r["published_at"] == NOW - timedelta(seconds=7)


def test_a_day_is_replaced_and_others_stay(spark, items):
    path = feeds.write_feed(items, scratch(spark), "json")
    feeds.write_feed(items.where(F.col("day") == date(2024, 1, 19)).withColumn("title", F.lit("again")), path, "json")
    titles = {r["guid"]["_VALUE"]: r["title"] for r in feeds.read_feed(spark, path, "json").collect()}
    assert titles["s1"] == "again" and titles["s0"] == HEAD[0] and len(titles) == 4


def test_changes(spark):
    e = spark.createDataFrame([(1, "m", "Price cut", "price", "floor", NOW), (2, "m", "New & old", "catalog", None, NOW), (3, "m", "?", "price", None, NOW)], "id long, model_slug string, summary string, event_type string, price_scope string, detected_at timestamp")
    path = feeds.write_feed(feeds.change_items(e, site="https://n.example"), scratch(spark))
    assert {(r["guid"]["_VALUE"], r["category"], r["title"], r["link"]) for r in feeds.read_feed(spark, path).collect()} == {("1", "price:floor", "Price cut", "https://n.example/models/m"), ("2", "catalog", "New & old", "https://n.example/models/m"), ("3", "price:", "?", "https://n.example/models/m")}
