"""Articles without texts are joined without texts."""

from pyspark.sql import functions as F

from lodestory.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def test_no_text_passes_a_join(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = Fixtures(spark, SF).articles().select("id", "source_url", "title", F.col("published_at"))
        tree = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "md5" in tree[tree.rindex("Join") :] and "md5" not in tree[: tree.rindex("Join")]
