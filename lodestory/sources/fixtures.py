"""The driver's tables seen as articles, models, offers and events: deterministic views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestory.functions import scalars as S

AS_OF = "2024-01-31 00:00:00"
PAPER_PREFIX = "src1"
NEWS, PAPER, BAND = 0.60, 0.55, 0.65
WINDOW_HOURS = 48
#: Keywords for the invented language of the test texts.
CATEGORIES = {"model-releases": ["hethe", "quela"], "research-papers": ["tion", "ción"], "company-news": ["ment"], "product-launches": ["sch"], "regulation-policy": ["ingth", "ande"], "open-source": ["ouen"]}
BUCKETS = {"coding": ["bench2", "bench3"], "math": ["bench4"], "reasoning": ["bench5", "bench6"], "agentic": ["bench3", "bench7"]}


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


class Fixtures:
    """Lazy views over one folder of driver tables; nothing is read until a query runs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def sources(self) -> DataFrame:
        k = F.col("id")
        authority = F.element_at(F.array(*map(F.lit, (10, 7, 5, 3))), (k % 4 + 1).cast("int"))
        return self.spark.range(20).select(F.concat(F.lit("src"), k).alias("name"), F.concat(F.lit("org"), k % 8).alias("organization"), authority.alias("authority"), (k % 3 == 0).alias("ai_filter"))

    def articles(self) -> DataFrame:
        # made before the joins, so that a query without texts moves none
        url = F.concat(F.lit("https://news.example/"), F.md5("text"))
        title = F.substring(F.trim(F.split_part("text", F.lit("\n"), F.lit(1))), 1, 120)
        d = self.table("documents").withColumn("title", title).withColumn("source_url", url)
        d = d.withColumn("category", S.categorize(F.col("title"), F.col("text"), CATEGORIES))
        e, s = self.events(), self.sources()
        v = self.table("embeddings").select("vec_id", "label")
        return (
            d.join(e, e["event_id"] == d["doc_id"] * 5)
            .join(F.broadcast(s), d["source"] == s["name"])  # twenty rows
            .join(v, v["vec_id"] == d["doc_id"], "left")
            .select(
                F.col("doc_id").alias("id"), "title", F.col("text").alias("body_excerpt"), F.col("source").alias("source_name"),
                "source_url", F.col("ts").alias("published_at"), "authority", "organization", "ai_filter", "lang",
                F.when(F.col("event_type") != "error", 1 + F.floor("value").cast("int") % 10).alias("impact"), "category",
                F.concat_ws("-", F.col("label").cast("string"), F.floor(F.col("doc_id") / 40).cast("string")).alias("_c"), "label",
            )
            .withColumn("cluster_id", F.when(F.col("label").isNotNull(), F.col("_c")))
            .drop("_c", "label")
        )

    def vectors(self) -> DataFrame:
        """id, published_at, source_name, cluster_id, vector."""
        a = self.articles().select("id", "published_at", "source_name", "cluster_id")
        e = self.table("embeddings")
        return a.join(e, a["id"] == e["vec_id"]).select("id", "published_at", "source_name", "cluster_id", F.col("embedding").alias("vector"))

    def clusters(self) -> DataFrame:
        from lodestory.operators.stories import story_table

        return story_table(self.articles())

    def models(self) -> DataFrame:
        p, k = self.table("part"), F.col("p_partkey")
        slug = S.slugify(F.col("p_name"))
        rank = F.row_number().over(Window.partitionBy("slug").orderBy("id"))
        released = F.date_add(F.lit("2022-12-01").cast("date"), (7 * k % 420).cast("int"))
        return (
            p.select(k.alias("id"), F.col("p_name").alias("name"), slug.alias("slug"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("family"), (F.col("p_size") * 1000).alias("context_window"), F.round(F.col("p_retailprice") / 100, 4).alias("price_in"), F.round(3 * F.round(F.col("p_retailprice") / 100, 4), 4).alias("price_out"), released.alias("released_at"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("is_open_weight"), (k % 11).alias("significance"))
            .withColumn("_r", rank)
            .withColumn("slug", F.when(F.col("_r") > 1, F.concat_ws("-", "slug", F.col("_r").cast("string"))).otherwise(F.col("slug")))
            .drop("_r")
        )

    def benchmarks(self) -> DataFrame:
        n = F.col("l_linenumber")
        rows = self.table("lineitem").groupBy("l_partkey", "l_linenumber").agg((F.max("l_quantity") / 50).alias("score"))
        return rows.select(F.col("l_partkey").alias("model_id"), F.concat(F.lit("bench"), n).alias("benchmark"), "score", F.when(n == 1, "index").otherwise("%").alias("unit"), F.when(n % 2 == 1, "primary").otherwise("secondary").alias("source"))

    def bucket_map(self) -> DataFrame:
        return self.spark.createDataFrame([(b, x) for b, xs in BUCKETS.items() for x in xs], "bucket string, benchmark string")

    def offers(self) -> DataFrame:
        l, p = self.table("lineitem"), self.table("part").select("p_partkey", "p_brand")
        price = F.col("l_extendedprice") / F.col("l_quantity") / 100
        quant = F.element_at(F.array(F.lit("fp8"), F.lit("fp4"), F.lit("bf16"), F.lit(None)), F.col("l_linenumber") % 4 + 1)
        return l.join(p, l["l_partkey"] == p["p_partkey"]).select(
            F.col("l_partkey").alias("model_id"), F.concat(F.lit("Brand#"), 1 + F.col("l_suppkey") % 25).alias("provider"), F.col("p_brand").alias("author"), F.col("l_shipdate").cast("timestamp").alias("sample_ts"),
            price.alias("price_in"), (price * (1 + 10 * F.col("l_tax"))).alias("price_out"), F.when(F.col("l_discount") >= 0.09, 0.5).otherwise(0.0).alias("discount"), quant.alias("quant"), (F.col("l_quantity") * 20000).cast("long").alias("context"),
            F.when(F.col("l_returnflag") == "R", -2).otherwise(0).alias("status"), F.concat(F.lit("brand"), F.col("l_suppkey"), F.when(F.col("l_linenumber") == 7, "/flex").otherwise("/std")).alias("tag"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        )

    def price_samples(self) -> DataFrame:
        first = F.row_number().over(Window.partitionBy("l_partkey", "l_shipdate").orderBy("l_orderkey", "l_linenumber"))
        rows = self.table("lineitem").withColumn("_r", first).where("_r = 1")
        seen, q = F.col("l_linenumber") % 5 != 0, F.col("l_quantity")
        steps = {"vendor_in": 25, "floor_in": 17, "vendor_out": 20, "floor_out": 13}
        prices = [F.when(seen, F.ceil(q / k).cast("double")).alias(c) for c, k in steps.items()]
        provider, quant = F.concat(F.lit("Brand#"), 1 + F.col("l_suppkey") % 25), F.element_at(F.array(F.lit("fp8"), F.lit("bf16"), F.lit(None)), F.col("l_linenumber") % 3 + 1)
        facts = [F.when(seen, v).alias(c) for c, v in (("floor_provider", provider), ("floor_quant", quant), ("floor_context", (q * 20000).cast("long")))]
        return rows.select(F.col("l_partkey").alias("model_id"), F.col("l_shipdate").cast("timestamp").alias("sample_ts"), *prices, *facts)

    def model_events(self) -> DataFrame:
        e = self.events()
        kinds = F.create_map(*[F.lit(x) for p in (("purchase", "price"), ("view", "benchmark"), ("click", "context"), ("signup", "catalog"), ("error", "deprecation")) for x in p])
        new = F.lead("value").over(Window.partitionBy("user_id").orderBy("event_id"))
        k = F.col("event_id") % 3
        return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("model_id"), F.element_at(kinds, F.col("event_type")).alias("event_type"), F.col("value").alias("old_num"), new.alias("new_num"), F.when(k == 1, "vendor").when(k == 2, "floor").alias("price_scope"), F.col("ts").alias("detected_at"))

    def model_clusters(self) -> DataFrame:
        e, a = self.events(), self.articles().where("cluster_id is not null").select("id", "cluster_id")
        return e.join(a, e["event_id"] == a["id"]).select(F.col("user_id").alias("model_id"), "cluster_id").distinct()

    def pipeline_runs(self) -> DataFrame:
        return self.events().where("event_type = 'signup' and user_id % 100 = 0").select(F.col("event_id").alias("id"), F.col("ts").alias("ran_at"), F.floor("value").alias("articles_ingested"), F.floor(F.col("value") / 2).alias("clusters_updated"))

    def waitlist(self) -> DataFrame:
        e = self.events()
        source = F.when(F.col("event_type").isin("signup", "purchase"), F.concat(F.lit("digest-"), "event_type")).otherwise(F.col("event_type"))
        return e.select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "User").otherwise("user"), F.col("user_id")).alias("email"), source.alias("source"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("stack"), F.col("ts").alias("created_at"))

    def aliases(self) -> DataFrame:
        words = F.split(F.lower("text"), " ")
        alias = F.array_join(F.slice(words, 1, 3), " ")
        return self.table("benchmark").select(F.col("item_id").alias("model_id"), alias.alias("alias")).where(F.length("alias") >= 8).groupBy("alias").agg(F.min("model_id").alias("model_id"))
