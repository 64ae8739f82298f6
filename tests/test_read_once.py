"""Queries that read a table several times make it once, without texts."""

import __spark_entry__ as entry
from pyspark.sql import functions as F

from lodestory.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def test_no_text_passes_a_join_for_its_category(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = Fixtures(spark, SF).articles().select("id", "category", F.col("published_at"))
        tree = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hethe" in tree[tree.rindex("Join") :] and "hethe" not in tree[: tree.rindex("Join")]


def test_pages_are_made_from_one_table_of_articles(spark, monkeypatch):
    made, articles = [], Fixtures.articles
    monkeypatch.setattr(Fixtures, "articles", lambda x: made.append(1) or articles(x))
    df = entry.queries()["M5_story_detail"](spark, SF)
    assert len(made) <= 2  # the articles, and the links of models
    assert df.count() and not any("documents" in f for f in df.inputFiles())


def test_both_sides_of_a_self_join_are_one_replay(spark, monkeypatch):
    from lodestory.plans import streams as Q

    made, replay = [], Q.replay
    monkeypatch.setattr(Q, "replay", lambda *a, **k: made.append(1) or replay(*a, **k))
    assert entry.queries()["K8_stream_time_join"](spark, SF).count() and len(made) == 1
