"""Story pages, ratings, registry pages and reset windows on small tables."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestory.plans import registry as G
from lodestory.plans.news import rated, scoring_batches, story_page
from lodestory.sources.fixtures import Fixtures
from lodestory.sources.sinks import reset_assignments

DAY = datetime(2024, 1, 10)


@pytest.fixture(scope="module")
def tables(spark):
    hours = lambda h: DAY + timedelta(hours=h)
    s = spark.createDataFrame([("a", "A", "x", 9.0, hours(0), 2), ("b", "B", "x", 5.0, hours(20), 1), ("c", "C", "x", 7.0, hours(95), 1), ("d", "D", "x", 9.0, hours(97), 1), ("e", "E", "y", 8.0, hours(1), 1), ("f", "F", "x", 7.0, hours(-95), 1)], "id string, headline string, category string, significance_score double, first_published_at timestamp, article_count long")
    a = spark.createDataFrame([(1, "t1", "o1", hours(0), 3, 4, "a", "x"), (2, "t2", "o2", hours(1), 7, None, "a", "x"), (3, "t3", "o1", hours(2), 7, 9, None, None)], "id long, title string, source_name string, published_at timestamp, authority int, impact int, cluster_id string, category string")
    m = spark.createDataFrame([(k, f"m{k}", f"M{k}", date(2024, 1, k) if k != 4 else None) for k in range(1, 6)], "id long, slug string, name string, released_at date")
    return s, a, m


def page(tables, links, key):
    s, a, m = tables
    k = s.sparkSession.createDataFrame(links, "model_id long, cluster_id string")
    out = {}
    for r in sorted(story_page(s, a, k, m, key).collect(), key=lambda r: (r["part"], r["pos"])):
        out.setdefault(r["part"], []).append((r["key"], r["text"]))
    return out


def test_story_page(tables):
    got = page(tables, [(k, "a") for k in range(1, 6)] + [(1, "e"), (2, "b")], "a")
    assert got["story"] == [("a", "A|x|9.0|2|2|4")]
    assert got["member"] == [("2", "t2"), ("1", "t1")]  # by authority
    assert got["model"] == [("m5", "M5"), ("m3", "M3"), ("m2", "M2")]  # three newest, one without a day last
    assert [k for k, _ in got["related"]] == ["e", "b"]  # those that share a model, whatever their category


def test_related_by_category_only_without_shared_models(tables):
    got = page(tables, [(1, "a"), (2, "e")], "a")
    assert [k for k, _ in got["related"]] == ["c", "f", "b"]  # within four days, by score and time


def test_article_without_a_story_and_unknown_key(tables):
    assert page(tables, [(1, "a")], "3") == {"story": [("3", "t3|uncategorized|0.0|1|1|9")], "member": [("3", "t3")]}
    assert page(tables, [(1, "a")], "zzz") == {"missing": [("zzz", None)]}


def test_ratings(spark):
    batches = spark.createDataFrame([(i, i // 3) for i in range(21)], "id long, batch long")
    answers = [
        (0, '[{"id": "0", "score": 7}, {"id": "1", "score": 99}]'), (1, '```json\n[{"id": "3", "score": -4}, {"id": "4", "score": 6.9}, {"id": "5", "score": "8"}]\n```'), (2, "no JSON"), (3, None),
        (4, '[{"id": "12", "score": "high"}, {"id": "13", "score": 3}]'), (5, '{"id": "15", "score": 3}'),
    ]
    got = {r["id"]: r["impact"] for r in rated(batches, spark.createDataFrame(answers, "batch long, answer string")).collect()}
    want = {0: 7, 1: 10, 2: None, 3: 1, 4: 6, 5: 8} | dict.fromkeys((6, 7, 8, 12, 13, 14, 15, 16, 17), 5) | dict.fromkeys((9, 10, 11, 18, 19, 20))
    assert got == want


def test_batches_are_newest_first(spark):
    rows = spark.createDataFrame([(i, DAY + timedelta(hours=7 * (i % 11))) for i in range(47)], "id long, published_at timestamp")
    order = sorted(((DAY + timedelta(hours=7 * (i % 11))), -i) for i in range(47))[::-1]
    assert {r["id"]: r["batch"] for r in scoring_batches(rows).collect()} == {-i: k // 10 for k, (_, i) in enumerate(order)}


def test_page_ranks_its_own_models(spark):
    x = Fixtures(spark, "/root/testdata/sf0.01")
    few = G.page(x, 20)
    ids = [r["id"] for r in few.collect()]
    scores = {}
    for r in x.benchmarks().collect():
        if r["model_id"] in ids:
            scores.setdefault(r["benchmark"], {})[r["model_id"]] = r["score"]
    share = {b: {m: int(100 * sum(o < s for o in own.values()) / (len(own) - 1) + 0.5) if len(own) > 1 else 100 for m, s in own.items()} for b, own in scores.items()}
    of = {"coding": ["bench2", "bench3"], "math": ["bench4"], "reasoning": ["bench5", "bench6"], "agentic": ["bench3", "bench7"]}
    year = {r["id"]: r for r in G.wide(x).collect()}
    differ = 0
    for r in G.wide(x, few).collect():
        for bucket, names in of.items():
            own = [share[b][r["id"]] for b in names if r["id"] in share.get(b, {})]
            assert r[bucket] == (int(sum(own) / len(own) + 0.5) if own else None)
            differ += r[bucket] != year[r["id"]][bucket]
    assert len(ids) == 20 and differ > 20  # the whole year gives other shares


def test_reset_derives_the_peak_again(spark):
    rows = [(1, "s", DAY), (2, "s", DAY + timedelta(days=1)), (3, "s", DAY + timedelta(days=1)), (4, "s", DAY + timedelta(days=5)), (5, "s", DAY + timedelta(days=5)), (6, "s", DAY + timedelta(days=5)), (7, "gone", DAY + timedelta(days=5)), (8, None, DAY)]
    a = spark.createDataFrame(rows, "id long, cluster_id string, published_at timestamp")
    members, stories = reset_assignments(a, F.lit(f"{DAY + timedelta(days=6)}").cast("timestamp"), 48)
    assert {r["id"] for r in members.where("cluster_id is null").collect()} == {4, 5, 6, 7, 8}
    assert [tuple(r) for r in stories.select("id", "article_count", "peak_date").collect()] == [("s", 3, (DAY + timedelta(days=1)).date())]
