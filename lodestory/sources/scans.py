"""Landed files as rows: CSV rosters and scores, JSON catalogs, offers and evaluations, feed items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestory.functions import scalars as S
from lodestory.functions import vocabulary as V

ROSTER = {"Model": "name", "Publication date": "published", "Organization": "vendor", "Parameters": "parameters", "Link": "primary_url", "Model accessibility": "accessibility", "Open model weights?": "open_weights", "Description": "description"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan_roster(spark: SparkSession, path: str, *, as_of: str, days: int) -> DataFrame:
    """Roster rows by header; missing columns are null, rows without a name or a recent date go."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", multiLine=True, escape='"')
    got = raw.select(*[(F.col(f"`{h}`") if h in raw.columns else F.lit(None).cast("string")).alias(c) for h, c in ROSTER.items()])
    rows = got.where((F.trim("name") != "") & S.within_window(F.col("published"), as_of, days))
    is_open = F.coalesce(S.coerce_tristate(F.col("open_weights")), S.tristate_access(F.col("accessibility")))
    return rows.select(
        F.trim("name").alias("name"), S.normalize_key(F.col("name")).alias("epoch_key"), S.slugify(F.col("name")).alias("slug"), F.col("vendor"), S.derive_family(F.col("name")).alias("family"), F.substring("published", 1, 10).try_cast("date").alias("released_at"),
        S.format_parameters(F.col("parameters")).alias("parameters"), "accessibility", is_open.alias("is_open_weight"), S.clean_description(F.col("description")).alias("description"), "primary_url",
    )


def scan_benchmark_files(spark: SparkSession, folder: str, files: Sequence[tuple[str, str, str, str]] = V.BENCHMARK_FILES) -> DataFrame:
    """version, benchmark, score, unit of all files that are there; unreadable scores are dropped."""
    out = None
    for name, display, unit, column in files:
        path = f"{folder}/{name}"
        if not exists(spark, path):
            continue
        raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
        if column not in raw.columns or "Model version" not in raw.columns:
            continue
        rows = raw.select(F.col("`Model version`").alias("version"), F.lit(display).alias("benchmark"), F.col(f"`{column}`").try_cast("double").alias("score"), F.lit(unit).alias("unit"))
        out = rows if out is None else out.unionByName(rows)
    empty = spark.createDataFrame([], "version string, benchmark string, score double, unit string")
    return (empty if out is None else out).where("score is not null")


CATALOG = "data array<struct<id: string, name: string, created: bigint, description: string, context_length: bigint, pricing: struct<prompt: string, completion: string>, architecture: struct<input_modalities: array<string>, output_modalities: array<string>>>>"


def scan_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per model of catalog payloads: key, vendor, name and prices per million tokens."""
    m = spark.read.json(path, schema=CATALOG, multiLine=True).select(F.explode("data").alias("m")).select("m.*")
    vendor, name = S.split_vendor_name(F.col("name"))
    return m.select(
        "id", S.catalog_key(F.col("id")).alias("key"), vendor.alias("vendor"), name.alias("name"), "created", S.clean_description(F.col("description")).alias("description"), F.col("context_length").alias("context_window"),
        S.price_per_million(F.col("pricing.prompt")).alias("price_in"), S.price_per_million(F.col("pricing.completion")).alias("price_out"),
        F.array_join("architecture.input_modalities", ", ").alias("input_modalities"), F.array_join("architecture.output_modalities", ", ").alias("output_modalities"),
    )


ENDPOINTS = "struct<endpoints: array<struct<provider_name: string, tag: string, context_length: bigint, quantization: string, status: int, pricing: struct<prompt: string, completion: string, discount: double>>>>"


def scan_endpoints(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """Offers of payload texts, one row per endpoint that has a price."""
    e = payloads.select(key, F.posexplode(F.from_json(payload, ENDPOINTS)["endpoints"]).alias("ordinal", "e"))
    rows = e.select(key, "ordinal", F.col("e.provider_name").alias("provider"), F.col("e.tag").alias("tag"), F.col("e.context_length").alias("context"), F.col("e.quantization").alias("quant"), F.coalesce("e.status", F.lit(0)).alias("status"), S.price_per_million(F.col("e.pricing.prompt")).alias("price_in"), S.price_per_million(F.col("e.pricing.completion")).alias("price_out"), F.coalesce("e.pricing.discount", F.lit(0.0)).alias("discount"))
    return rows.where("price_in is not null")


def scan_evaluations(payloads: DataFrame, key: str, payload: str, fields: Sequence[tuple[str, str, str]] = V.EVALUATIONS) -> DataFrame:
    """Long (key, benchmark, score, unit) rows of evaluation payloads, nulls dropped."""
    kind = "struct<evaluations: struct<" + ", ".join(f"{f}: double" for f, _, _ in fields) + ">>"
    p = payloads.select(key, F.from_json(payload, kind)["evaluations"].alias("e"))
    long = F.array(*[F.struct(F.lit(d).alias("benchmark"), F.col(f"e.{f}").alias("score"), F.lit(u).alias("unit")) for f, d, u in fields])
    return p.select(key, F.explode(long).alias("s")).select(key, "s.*").where("score is not null")


def scan_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: url is link or guid, excerpt is the description, time is parsed to UTC."""
    kind = "title string, link string, guid string, description string, author string, pubDate string, updated string"
    raw = spark.read.format("xml").option("rowTag", "item").schema(kind).load(path)
    return raw.select(F.trim("title").alias("title"), F.coalesce("link", "guid").alias("source_url"), S.strip_html(F.col("description")).alias("body_excerpt"), "author", S.to_utc_timestamp_any(F.coalesce("pubDate", "updated")).alias("published_at"))


def scan_stories(items: DataFrame, base: str = "https://news.example/item?id=", words: Sequence[str] = V.STORY_KEYWORDS) -> DataFrame:
    """Story items with a title that holds a topic word; the url is rebuilt from the id."""
    kept = items.where((F.col("type") == "story") & (F.coalesce("title", F.lit("")) != "") & S.contains_any(F.lower("title"), words))
    return kept.select("id", "title", F.concat(F.lit(base), "id").alias("source_url"), F.timestamp_seconds("time").alias("published_at"))


def scan_releases(items: DataFrame, now, days: int = 7) -> DataFrame:
    """Releases that are neither drafts nor previews nor rolling builds, of the last days."""
    at = S.to_utc_timestamp_any(F.col("published_at"))
    rows = items.withColumn("at", at).where(~F.col("draft") & ~F.col("prerelease") & F.col("at").isNotNull() & (F.col("at") >= now - F.make_dt_interval(F.lit(days))))
    rows = rows.where(~S.is_rolling_build(F.col("tag_name"), F.col("name")))
    title = F.concat_ws(" ", "repo", "tag_name", F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("— "), "name")))
    return rows.select("repo", title.alias("title"), S.clean_release_body(F.col("body")).alias("body_excerpt"), "html_url", "at")
