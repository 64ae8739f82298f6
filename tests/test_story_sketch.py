"""The sketch of a story: one scan, mergeable, equal to the single aggregates."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestory.operators import stories as T
from lodestory.plans import all_queries
from lodestory.sources.fixtures import Fixtures
from lodestory.storage import scratch
from lodestory.streaming import streams as R
from tests.compare import spark_rows

SF = "/root/testdata/sf0.01"


def test_sketch_equals_the_single_aggregates(spark):
    a = Fixtures(spark, SF).articles()
    single = reduce(lambda x, y: x.join(y, "cluster_id", "left"), [T.cluster_meta(a), T.max_impact(a), T.peak_day(a), T.category_majority(a), T.pick_headline(a), T.paper_only(a, "src1"), T.cluster_score(a), T.best_article(a)])
    want = single.select(F.col("cluster_id").alias("id"), "article_count", "first_published_at", "max_impact", "peak_date", F.coalesce("category", F.lit("uncategorized")).alias("category"), "headline", "paper_only", "raw_score", "significance_score", F.col("article_id").alias("best_id"), F.col("source_name").alias("best_source"), F.col("source_url").alias("best_url"))
    got = T.story_table(a)
    assert spark_rows(got.select(want.columns)) == spark_rows(want)


def test_parts_merge_in_any_order(spark):
    a = Fixtures(spark, SF).articles()
    parts = [T.story_sketch(a.where(F.col("id") % 3 == k)) for k in (2, 0, 1)]
    assert spark_rows(T.story_rows(T.merge_sketches(*parts))) == spark_rows(T.story_table(a))


def test_stream_of_articles_equals_the_batch(spark):
    a = Fixtures(spark, SF).articles().where("cluster_id is not null")
    path = scratch(spark)
    for k in range(4):
        a.where(F.col("id") * 37 % 101 % 4 == k).coalesce(1).write.mode("append").parquet(path)
    got = R.story_batches(R.read_stream(spark, path, files=1), scratch(spark))
    assert spark_rows(got) == spark_rows(T.story_table(a))


def scans(df: DataFrame, name: str) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count(f"{name}.parquet]")


def test_one_scan(spark):
    x = Fixtures(spark, SF)
    assert scans(x.clusters(), "documents") == 1
    for name in ("I6_cluster_score", "M1_top_stories"):
        assert scans(all_queries()[name](spark, SF), "documents") == 1, name


def test_story_without_anything_but_articles(spark):
    rows = [(1, "s", None, None, "src7", None, None, None, "uncategorized", "2024-01-01 00:00:00"), (2, None, "x", 5, "src1", 9, "t", "u", "a", "2024-01-01 00:00:00")]
    a = spark.createDataFrame(rows, "id long, cluster_id string, organization string, authority int, source_name string, impact int, title string, source_url string, category string, at string").withColumn("published_at", F.to_timestamp("at"))
    (r,) = T.story_table(a).collect()
    assert (r["id"], r["headline"], r["category"], r["raw_score"], r["max_impact"], r["source_count"], r["paper_only"]) == ("s", None, "uncategorized", 0.0, 5, 1, False)
