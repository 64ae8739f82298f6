"""Feeds as files: items of stories and of changes, written as RSS or JSON with a folder per day, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestory.operators.stories import recent, top_k

#: Signs that XML can't hold.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
#: An item as it is read back.
ITEM = "title string, link string, guid struct<_VALUE: string, _isPermaLink: string>, pubDate string, description string, category string, day date"


def story_link(site: str, ident: Column, headline: Column) -> Column:
    """The page of a story: its id and, if anything is left of it, the headline in lower-case words of at most 80 signs."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(headline), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.coalesce(F.regexp_replace(F.substring(slug, 1, 80), "-+$", ""), F.lit(""))
    return F.concat(F.lit(f"{site}/story/"), ident, F.when(slug != "", F.concat(F.lit("/"), slug)).otherwise(F.lit("")))


def _item(title: Column, link: Column, ident: Column, at: Column, **rest: Column) -> list[Column]:
    plain = lambda c: F.regexp_replace(c, CONTROL, "")
    guid = F.struct(ident.cast("string").alias("_VALUE"), F.lit("false").alias("_isPermaLink"))
    stamp = F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return [plain(title).alias("title"), link.alias("link"), guid.alias("guid"), stamp.alias("pubDate"), *[plain(c).alias(k) for k, c in rest.items()], F.to_date(at).alias("day")]


def story_items(stories: DataFrame, articles: DataFrame, now: Column, *, site: str, days: int = 7, least: float = 5, most: int = 50) -> DataFrame:
    """The newest stories of the last days from a score on, told by their best article's excerpt and source."""
    fit = recent(stories, "first_published_at", now, days).where(F.col("significance_score") >= least)
    top = top_k(fit, most, F.col("first_published_at").desc(), F.col("id"))
    told = top.join(articles.select(F.col("id").alias("best_id"), "body_excerpt", "source_url"), "best_id", "left")
    source = F.coalesce(F.concat(F.lit(" (Source: "), "source_url", F.lit(")")), F.lit(""))
    about = F.concat(F.coalesce("body_excerpt", F.lit("")), source)
    return told.select(*_item(F.col("headline"), story_link(site, F.col("id"), F.col("headline")), F.col("id"), F.col("first_published_at"), description=about))


def change_items(events: DataFrame, *, site: str) -> DataFrame:
    """Events (id, model_slug, summary, event_type, price_scope, detected_at), prices under their scope."""
    kind = F.when(F.col("event_type") == "price", F.concat(F.lit("price:"), F.coalesce("price_scope", F.lit("")))).otherwise(F.col("event_type"))
    return events.select(*_item(F.col("summary"), F.concat(F.lit(f"{site}/models/"), "model_slug"), F.col("id"), F.col("detected_at"), category=kind))


def write_feed(items: DataFrame, path: str, kind: str = "xml") -> str:
    """Items in folders of their days, each day's files replaced as a whole when it is written again."""
    out = items.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day")
    if kind == "xml":
        out = out.option("rowTag", "item").option("rootTag", 'rss version="2.0"').option("declaration", 'version="1.0" encoding="UTF-8"')
    out.format(kind).save(path)
    return path


def read_feed(spark: SparkSession, path: str, kind: str = "xml") -> DataFrame:
    raw = spark.read.schema(ITEM).format(kind)
    return (raw.option("rowTag", "item") if kind == "xml" else raw).load(path)
