"""The model registry: variants, percentiles, rankings, frontiers and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestory.functions import scalars as S
from lodestory.functions import vocabulary as V
from lodestory.operators.aliases import match_aliases as match_models  # noqa: F401  (part of the registry's interface)
from lodestory.operators.scan import rank_shares, running_max, share
from lodestory.operators.stories import first_per_key, top_k


def last_year(models: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    return models.where(F.col("released_at") >= F.date_sub(as_of.cast("date"), days))


def percentiles(scores: DataFrame) -> DataFrame:
    """pct within each benchmark: share of the others that are below, half up; a lone model has 100."""
    placed = rank_shares(scores, ["benchmark"], "score", "model_id")
    pct = F.coalesce(S.half_up(share(F.col("below"), F.col("size")) * 100), F.lit(100)).cast("long")
    return placed.withColumn("pct", pct).drop("below", "size")


def bucket_scores(pct: DataFrame, buckets: DataFrame) -> DataFrame:
    """model_id, bucket, score: the mean percentile over a bucket's benchmarks that a model has. The map of
    buckets is a fixed list of some dozens, so it is sent to every task."""
    return pct.join(F.broadcast(buckets), "benchmark").groupBy("model_id", "bucket").agg(S.half_up(F.avg("pct")).alias("score"))


def overall(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("model_id").agg(S.half_up(F.avg("score")).alias("overall"))


def best_variant(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model_id", "benchmark").agg(F.max("score").alias("score"))


def strongest_variant(variants: DataFrame, key: str, index: str, order: str) -> DataFrame:
    """The whole row of the variant with the highest index; null counts -1, the first of equals wins."""
    return first_per_key(variants, [key], F.coalesce(F.col(index), F.lit(-1.0)).desc(), order)


def strongest_with(variants: DataFrame, key: str, index: str, order: str, metrics: list[str]) -> DataFrame:
    """The strongest variant, dropped afterwards if it has none of the metrics."""
    return strongest_variant(variants, key, index, order).where(S.any_of([F.col(m).isNotNull() for m in metrics]))


def cheapest_variant(rows: DataFrame, key: str, price: str, order: str) -> DataFrame:
    """Lowest positive price; anything beats null; the first of equals wins."""
    p = F.when(F.col(price) > 0, F.col(price))
    return first_per_key(rows.withColumn(price, p), [key], F.col(price).isNull(), price, order)


def running_max_frontier(rows: DataFrame, x: str, y: str, ident: str, groups: list[str] | None = None) -> DataFrame:
    """Rows, by rising x (ties by id), whose y beats every row before, in each group."""
    risen = running_max(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), groups or [], [x, ident], y)
    return risen.where(F.col("before").isNull() | (F.col(y) > F.col("before"))).drop("before")


def flagships(cands: DataFrame, k: int = 8) -> DataFrame:
    """The model with the highest index of each canonical vendor, then the k best vendors."""
    own = first_per_key(cands.withColumn("v", S.norm_vendor(F.col("vendor"))), ["v"], F.col("eci").desc(), "id")
    return top_k(own, k, F.col("eci").desc(), F.col("id"))


def unordered_pairs(rows: DataFrame, key: str) -> DataFrame:
    a, b = rows.select(F.col(key).alias("a")), rows.select(F.col(key).alias("b"))
    return a.join(b, F.col("a") < F.col("b"))


def compare_pairs(cands: DataFrame, landmark: int) -> DataFrame:
    """Pairs of flagships, and well covered models against their vendor's flagship."""
    top = flagships(cands)
    own = cands.where(F.col("news") >= landmark).withColumn("v", S.norm_vendor(F.col("vendor")))
    rival = own.join(top.select("v", F.col("slug").alias("f")), "v").where("slug <> f")
    second = rival.select(F.least("slug", "f").alias("a"), F.greatest("slug", "f").alias("b"))
    return unordered_pairs(top, "slug").unionByName(second).distinct()


def best_in_row(models: DataFrame, attributes: dict[str, bool]) -> DataFrame:
    """attribute, winner: for each attribute (True: higher is better) the best model, none if fewer
    than two have it; the first by id of equals."""
    long = models.select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), (F.col(a) if up else -F.col(a)).cast("double").alias("v")) for a, up in attributes.items()])).alias("s")).select("id", "s.*").where("v is not null")
    return long.groupBy("attribute").agg(F.max_by("id", F.struct("v", -F.col("id"))).alias("winner"), F.count("*").alias("n")).where("n >= 2").drop("n")


def rank_models(models: DataFrame, view: str) -> DataFrame:
    """Adds `value` for the view (overall, value or a bucket's column), drops models without it."""
    value = {"overall": F.col("eci"), "value": F.col("eci") / S.blended_price(F.col("price_in"), F.col("price_out"))}.get(view)
    return models.withColumn("value", F.col(view) if value is None else value).where("value is not null")


def alias_index(models: DataFrame) -> DataFrame:
    """alias, model_id: full lower-case names of four letters or more, and names without their
    umbrella word if four letters with a digit are left; the first registration wins."""
    low = F.lower(F.trim("name"))
    short = F.when(low.startswith(V.UMBRELLA_PREFIX), F.trim(F.substring(low, F.lit(len(V.UMBRELLA_PREFIX) + 1), F.length(low))))
    rows = models.select("id", F.explode(F.array(F.struct(F.lit(0).alias("k"), low.alias("alias")), F.struct(F.lit(1).alias("k"), short.alias("alias")))).alias("s")).select("id", "s.*")
    fit = (F.length("alias") >= 4) & ((F.col("k") == 0) | F.col("alias").rlike("[0-9]"))
    return rows.where(fit).groupBy("alias").agg(F.min_by("id", F.struct("id", "k")).alias("model_id"))
