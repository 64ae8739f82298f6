"""Stories: aggregates of articles, scores, and the joins and orders that pages use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestory.functions import scalars as S
from lodestory.functions.vocabulary import UNCATEGORIZED


def cluster_meta(articles: DataFrame) -> DataFrame:
    return articles.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("article_count"), F.min("published_at").alias("first_published_at"))


def peak_day(articles: DataFrame) -> DataFrame:
    """The day with most articles, the earliest of equals."""
    days = articles.where("cluster_id is not null").groupBy("cluster_id", F.to_date("published_at").alias("day")).count()
    return days.groupBy("cluster_id").agg(F.min_by("day", F.struct(-F.col("count"), "day")).alias("peak_date"))


def org_max(articles: DataFrame) -> DataFrame:
    """Highest authority per story and organisation; an unknown outlet is its own organisation."""
    org = F.coalesce("organization", "source_name")
    return articles.where("cluster_id is not null").groupBy("cluster_id", org.alias("organization")).agg(F.max("authority").alias("authority"))


def weighted_base(orgs: DataFrame, decay: float = 0.6) -> DataFrame:
    """Sum of authorities, each lower one weighing `decay` times less."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("authority").desc(), "organization"))
    return orgs.withColumn("_r", rank).groupBy("cluster_id").agg(F.sum(F.col("authority") * F.pow(F.lit(decay), F.col("_r") - 1)).alias("base"))


def coverage_multiplier(orgs: DataFrame) -> DataFrame:
    breadth = F.sum(F.least(F.lit(1.0), F.col("authority") / 7.0)) - 1
    return orgs.groupBy("cluster_id").agg((1 + 0.25 * F.greatest(F.lit(0.0), breadth)).alias("breadth"))


def max_impact(articles: DataFrame) -> DataFrame:
    return articles.where("cluster_id is not null").groupBy("cluster_id").agg(F.coalesce(F.max("impact"), F.lit(5)).alias("max_impact"))


def category_majority(articles: DataFrame) -> DataFrame:
    """Most frequent real category; ties by the earliest member, then by name."""
    votes = articles.where(F.col("cluster_id").isNotNull() & F.col("category").isNotNull() & (F.col("category") != UNCATEGORIZED))
    votes = votes.groupBy("cluster_id", "category").agg(F.count("*").alias("n"), F.min(F.struct("published_at", "id")).alias("f"))
    return votes.groupBy("cluster_id").agg(F.min_by("category", F.struct(-F.col("n"), "f", "category")).alias("category"))


def pick_headline(articles: DataFrame) -> DataFrame:
    """Title of the highest authority, the earliest of equals."""
    return articles.where("cluster_id is not null").groupBy("cluster_id").agg(F.min_by("title", F.struct(-F.col("authority"), "published_at", "id")).alias("headline"))


def paper_only(articles: DataFrame, prefix: str) -> DataFrame:
    return articles.where("cluster_id is not null").groupBy("cluster_id").agg(F.coalesce(F.bool_and(F.col("source_name").startswith(prefix)), F.lit(False)).alias("paper_only"))


def cluster_score(articles: DataFrame) -> DataFrame:
    """cluster_id, raw_score, significance_score: base x impact x breadth, compressed to 1..10."""
    orgs = org_max(articles)
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("authority").desc(), "organization"))
    parts = orgs.withColumn("_r", rank).groupBy("cluster_id").agg(
        F.sum(F.col("authority") * F.pow(F.lit(0.6), F.col("_r") - 1)).alias("base"),
        (1 + 0.25 * F.greatest(F.lit(0.0), F.sum(F.least(F.lit(1.0), F.col("authority") / 7.0)) - 1)).alias("breadth"),
    )
    raw = F.col("base") * (F.col("max_impact") / 5.0) * F.col("breadth")
    out = parts.join(max_impact(articles), "cluster_id").withColumn("raw_score", raw)
    return out.select("cluster_id", "raw_score", S.normalize_score(F.col("raw_score")).alias("significance_score"))


#: What a story's sketch counts beside the story as a whole.
ALL, ORG, DAY, CATEGORY, OUTLET = range(5)


def story_sketch(articles: DataFrame, paper_prefix: str = "src1") -> DataFrame:
    """What stories are derived from, in one pass over their articles: a row per story and thing counted
    (the story itself, an organisation, a day, a category, an outlet) with its articles, first article,
    highest authority and impact, and for the story whether all are papers and its best article.

    Sums, minima and maxima all merge: sketches of parts of the articles, united by merge_sketches,
    are the sketch of all.
    """
    a = articles.where(F.col("cluster_id").isNotNull())
    thing = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    things = F.array(thing(ALL, F.lit("")), thing(ORG, F.coalesce("organization", "source_name")), thing(DAY, F.to_date("published_at")), thing(CATEGORY, F.col("category")), thing(OUTLET, F.col("source_name")))
    best = F.struct(F.coalesce(-F.col("authority"), F.lit(1)).alias("rank"), "published_at", "id", "title", "source_name", "source_url")
    rows = a.select(
        "cluster_id", F.explode(things).alias("thing"), F.lit(1).cast("long").alias("n"), F.struct("published_at", "id").alias("first"), F.col("authority"), F.col("impact"),
        F.coalesce(F.col("source_name").startswith(paper_prefix), F.lit(False)).alias("papers"), best.alias("best"),
    )
    whole = F.col("thing.kind") == ALL
    return _merged(rows.select("cluster_id", "thing.*", "n", "first", "authority", "impact", "papers", F.when(whole, F.col("best")).alias("best")))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster_id", "kind", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("authority").alias("authority"), F.max("impact").alias("impact"), F.bool_and("papers").alias("papers"), F.min("best").alias("best"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    return _merged(reduce(DataFrame.unionByName, parts))


def story_rows(sketch: DataFrame, decay: float = 0.6) -> DataFrame:
    """One row per story with every derived column, from its sketch: a few rows a story, not its articles."""
    kind, key = F.col("kind"), F.col("key")
    whole = lambda c: F.max(F.when(kind == ALL, F.col(c)))
    orgs = F.array_sort(F.collect_list(F.when(kind == ORG, F.struct((-F.col("authority")).alias("a"), "key"))))
    real = (kind == CATEGORY) & key.isNotNull() & (key != UNCATEGORIZED)
    s = sketch.groupBy(F.col("cluster_id").alias("id")).agg(
        whole("n").alias("article_count"), whole("first.published_at").alias("first_published_at"), F.coalesce(whole("impact"), F.lit(5)).alias("max_impact"), F.count_if((kind == OUTLET) & key.isNotNull()).alias("source_count"),
        whole("papers").alias("paper_only"), F.min("best").alias("best"), orgs.alias("orgs"),
        F.min_by(F.when(kind == DAY, key.cast("date")), F.when(kind == DAY, F.struct(-F.col("n"), "key"))).alias("peak_date"), F.min_by(F.when(real, key), F.when(real, F.struct(-F.col("n"), "first", "key"))).alias("category"),
    )
    weights = F.transform("orgs", lambda o, i: -o["a"] * F.pow(F.lit(decay), i))
    zero = F.lit(0.0)
    base = F.aggregate(weights, zero, lambda t, w: t + F.coalesce(w, zero))
    reach = F.aggregate("orgs", zero, lambda t, o: t + F.coalesce(F.least(F.lit(1.0), -o["a"] / 7.0), zero))
    raw = base * (F.col("max_impact") / 5.0) * (1 + 0.25 * F.greatest(zero, reach - 1))
    return s.withColumn("raw_score", raw).select(
        "id", F.col("best.title").alias("headline"), F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category"), S.normalize_score(F.col("raw_score")).alias("significance_score"), "raw_score", "first_published_at", "peak_date",
        "article_count", "max_impact", "source_count", "paper_only", F.col("best.id").alias("best_id"), F.col("best.source_name").alias("best_source"), F.col("best.source_url").alias("best_url"),
    )


def story_table(articles: DataFrame, paper_prefix: str = "src1") -> DataFrame:
    """One row per story with every derived column, in one pass over the articles."""
    return story_rows(story_sketch(articles, paper_prefix))


def top_members(articles: DataFrame, k: int = 3) -> DataFrame:
    """The first k articles of each story by authority, ties by time and id; adds `rank`."""
    line = Window.partitionBy("cluster_id").orderBy(F.col("authority").desc_nulls_last(), "published_at", "id")
    return articles.where("cluster_id is not null").withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)


def best_article(articles: DataFrame) -> DataFrame:
    """One article per story: cluster_id, article_id, title, source_name, source_url."""
    return top_members(articles, 1).select("cluster_id", F.col("id").alias("article_id"), "title", "source_name", "source_url")


def recent(df: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    return df.where(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows: a take-ordered plan, no full sort."""
    return df.orderBy(*order).limit(k)


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str, k: int = 1) -> DataFrame:
    """First k rows of each key; Spark trims each partition to k before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def search(stories: DataFrame, articles: DataFrame, patterns: list[str], *, head: int = 100, newest: int = 500, outlets: int = 100) -> DataFrame:
    """Headline hits first, then stories of the newest matching outlets' articles not yet there."""
    hit = S.contains_any(F.lower("headline"), [p.lower() for p in patterns])
    first = top_k(stories.where(hit), head, F.col("significance_score").desc(), F.col("first_published_at").desc(), F.col("id")).select("id", F.lit(0).alias("part"))
    named = articles.where(F.col("cluster_id").isNotNull() & S.contains_any(F.lower("source_name"), [p.lower() for p in patterns]))
    fresh = top_k(named, newest, F.col("published_at").desc(), F.col("id")).groupBy("cluster_id").agg(F.max("published_at").alias("last"))
    second = top_k(fresh, outlets, F.col("last").desc(), F.col("cluster_id")).select(F.col("cluster_id").alias("id"), F.lit(1).alias("part"))
    return first.unionByName(second).groupBy("id").agg(F.min("part").alias("part")).join(stories, "id")
