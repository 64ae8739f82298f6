"""Queries over landed files, which are first written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestory.plans.catalog import query
from lodestory.sources import scans as C
from lodestory.sources.feeds import CONTROL
from lodestory.sources.fixtures import AS_OF, Fixtures, as_of
from lodestory.storage import scratch

#: Models of a catalog payload, and items of a feed file, at most.
PAYLOAD_MODELS, FEED_ITEMS = 5000, 50_000
YEAR = "released_at >= DATE '2024-01-31' - 365"


@query("A2_scan_roster_csv", f"SELECT name, slug0 AS slug, vendor, released_at, id % 2 = 0 AS is_open_weight, (context_window // 1000) || 'B' AS parameters FROM models_0 WHERE {YEAR}")
def _(x: Fixtures):
    m = x.models()
    landed = m.select(F.col("name").alias("Model"), F.col("released_at").cast("string").alias("Publication date"), F.col("vendor").alias("Organization"), (F.col("context_window").cast("long") * 1_000_000).cast("string").alias("Parameters"), F.when(F.col("id") % 2 == 0, "Open weights").otherwise("API access").alias("Model accessibility"))
    path = scratch(x.spark)
    landed.write.csv(path, header=True)
    return C.scan_roster(x.spark, path, as_of=AS_OF, days=365).select("name", "slug", "vendor", "released_at", "is_open_weight", "parameters")


@query("A3_scan_benchmark_files", "SELECT 'm' || model_id AS version, CASE benchmark WHEN 'bench1' THEN 'Epoch Capabilities Index' ELSE 'GPQA Diamond' END AS benchmark, score, unit FROM model_benchmarks WHERE benchmark IN ('bench1', 'bench2') AND model_id % 9 <> 0")
def _(x):
    b, path = x.benchmarks(), scratch(x.spark)
    for name, bench, column in (("epoch_capabilities_index.csv", "bench1", "ECI Score"), ("gpqa_diamond.csv", "bench2", "mean_score")):
        score = F.when(F.col("model_id") % 9 == 0, "n/a").otherwise(F.col("score").cast("string"))
        b.where(F.col("benchmark") == bench).select(F.concat(F.lit("m"), "model_id").alias("Model version"), score.alias(column)).write.csv(f"{path}/{name}", header=True)
    return C.scan_benchmark_files(x.spark, path)


@query("A4_scan_catalog_json", "SELECT 'brand/' || replace(name, ' ', '-') || ':free' AS id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, vendor, name, context_window FROM models")
def _(x):
    m, path = x.models(), scratch(x.spark)
    model = F.struct(F.concat(F.lit("brand/"), F.replace("name", F.lit(" "), F.lit("-")), F.lit(":free")).alias("id"), F.concat("vendor", F.lit(": "), "name").alias("name"), F.col("context_window").alias("context_length"), F.struct(F.lit("0.000001").alias("prompt")).alias("pricing"))
    payloads = m.groupBy(F.floor(F.col("id") / PAYLOAD_MODELS).alias("part")).agg(F.to_json(F.struct(F.collect_list(model).alias("data"))).alias("value"))
    payloads.write.partitionBy("part").text(path)  # a folder and file for each, as a file holds one payload
    return C.scan_catalog(x.spark, path).select("id", "key", "vendor", "name", "context_window")


@query("A5_scan_endpoints_json", "SELECT model_id, provider, tag, context, quant, status, discount FROM offers")
def _(x):
    o = x.offers()
    price = F.struct(F.format_string("%.12f", F.col("price_in") / 1e6).alias("prompt"), F.format_string("%.12f", F.col("price_out") / 1e6).alias("completion"), "discount")
    e = F.struct(F.col("provider").alias("provider_name"), "tag", F.col("context").alias("context_length"), F.col("quant").alias("quantization"), "status", price.alias("pricing"))
    payloads = o.groupBy("model_id").agg(F.to_json(F.struct(F.collect_list(e).alias("endpoints"))).alias("payload"))
    return C.scan_endpoints(payloads, "model_id", "payload").select("model_id", "provider", "tag", "context", "quant", "status", "discount")


@query("A6_scan_eval_json", "SELECT model_id, CASE benchmark WHEN 'bench2' THEN 'GPQA Diamond' WHEN 'bench3' THEN 'SciCode' ELSE 'MMLU-Pro' END AS benchmark, score, '%' AS unit FROM model_benchmarks WHERE benchmark IN ('bench2', 'bench3', 'bench4')")
def _(x):
    b = x.benchmarks().groupBy("model_id").pivot("benchmark", ["bench2", "bench3", "bench4"]).agg(F.max("score"))
    fields = F.struct(F.col("bench2").alias("gpqa"), F.col("bench3").alias("scicode"), F.col("bench4").alias("mmlu_pro"))
    return C.scan_evaluations(b.select("model_id", F.to_json(F.struct(fields.alias("evaluations"))).alias("payload")), "model_id", "payload")


@query("A7_scan_feed_items", "SELECT 'item ' || event_id AS title, CASE WHEN event_id % 2 = 0 THEN 'https://a.example/' || event_id ELSE 'guid-' || event_id END AS source_url, 'about ' || event_type AS body_excerpt, epoch_us(ts) // 1000000 AS seconds FROM events")
def _(x):
    e, path = x.events(), scratch(x.spark)
    even, number = F.col("event_id") % 2 == 0, F.col("event_id").cast("string")
    link, guid = F.when(even, F.concat(F.lit("https://a.example/"), number)).alias("link"), F.when(~even, F.concat(F.lit("guid-"), number)).alias("guid")
    about = F.concat(F.lit("<b>about</b> "), "event_type").alias("description")
    land_items(e.select(F.concat(F.lit(" item "), number).alias("title"), link, guid, about, F.floor(F.unix_micros("ts") / 1000000).alias("pubDate")), path)
    rows = C.scan_feed(x.spark, path)
    return rows.select("title", "source_url", "body_excerpt", F.floor(F.unix_micros("published_at") / 1000000).alias("seconds"))


@query("A8_scan_story_items", "SELECT id, title, 'https://news.example/item?id=' || id AS source_url FROM articles WHERE id % 3 <> 0 AND (contains(lower(title), 'the ') OR contains(lower(title), 'ai'))")
def _(x):
    a = x.articles().select("id", "title", F.when(F.col("id") % 3 == 0, "comment").otherwise("story").alias("type"), F.unix_seconds("published_at").alias("time"))
    return C.scan_stories(a, words=["the ", "ai"]).select("id", "title", "source_url")


@query("A9_scan_release_items", "SELECT 'r/' || user_id AS repo, 'r/' || user_id || ' v1.' || event_id || ' — ' || event_type AS title FROM events WHERE event_type NOT IN ('error', 'view') AND event_id % 4 <> 0 AND ts >= AS_OF - INTERVAL 28 DAY")
def _(x):
    e = x.events()
    tag = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("b"), "event_id")).otherwise(F.concat(F.lit("v1."), "event_id"))
    items = e.select(F.concat(F.lit("r/"), "user_id").alias("repo"), tag.alias("tag_name"), F.col("event_type").alias("name"), F.lit("notes").alias("body"), F.lit("u").alias("html_url"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("published_at"), (F.col("event_type") == "error").alias("draft"), (F.col("event_type") == "view").alias("prerelease"))
    return C.scan_releases(items, as_of(), 28).select("repo", "title")


def land_items(items: DataFrame, path: str) -> None:
    """Items as RSS files of at most FEED_ITEMS, each with one root: a reader stops at the end of the first."""
    items.write.format("xml").option("rowTag", "item").option("rootTag", "rss").option("maxRecordsPerFile", FEED_ITEMS).save(path)


def land_feed(x: Fixtures, articles: DataFrame) -> DataFrame:
    """Articles written as feed files and scanned again."""
    path, plain = scratch(x.spark), lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), CONTROL, "").alias(c)
    land_items(articles.select(plain("title"), F.col("source_url").alias("link"), plain("body_excerpt").alias("description"), F.floor(F.unix_micros("published_at") / 1000000).alias("pubDate")), path)
    return C.scan_feed(x.spark, path)
