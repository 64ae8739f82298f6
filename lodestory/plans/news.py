"""Queries over articles and stories."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestory.functions import scalars as S
from lodestory.operators import stories as T
from lodestory.operators.scan import beside
from lodestory.plans.catalog import query
from lodestory.sources.fixtures import PAPER_PREFIX, Fixtures, as_of
from lodestory.storage import cut, scratch

DAY = "2024-01-03"


def order():
    return F.col("significance_score").desc(), F.col("first_published_at").desc(), F.col("id")


SQL_ORDER = "significance_score DESC, first_published_at DESC, id"


@query("A1_scan_articles", "SELECT id, title, source_name, source_url, published_at, category FROM articles")
def _(x: Fixtures) -> DataFrame:
    return x.articles().select("id", "title", "source_name", "source_url", "published_at", "category")


@query("B1_filter_recent_window", "SELECT id, published_at FROM articles WHERE published_at >= AS_OF - INTERVAL 28 DAY")
def _(x):
    return T.recent(x.articles(), "published_at", as_of(), 28).select("id", "published_at")


@query("B2_filter_utc_day", f"SELECT id, published_at FROM articles WHERE published_at >= DATE '{DAY}' AND published_at < DATE '{DAY}' + INTERVAL 1 DAY")
def _(x):
    start = F.lit(DAY).cast("date").cast("timestamp")
    return x.articles().where((F.col("published_at") >= start) & (F.col("published_at") < start + F.expr("INTERVAL 1 DAY"))).select("id", "published_at")


@query("B3_filter_peak_day", f"SELECT id, peak_date FROM clusters WHERE peak_date = DATE '{DAY}'")
def _(x):
    return x.clusters().where(F.col("peak_date") == F.lit(DAY).cast("date")).select("id", "peak_date")


def optional_category(df: DataFrame, category: str | None) -> DataFrame:
    """No category, no predicate."""
    return df if category is None else df.where(F.col("category") == category)


@query("B4_filter_optional_category", "SELECT 'all' AS part, id FROM clusters UNION ALL SELECT 'one', id FROM clusters WHERE category = 'research-papers'")
def _(x):
    c = x.clusters()
    return optional_category(c, None).select(F.lit("all").alias("part"), "id").unionByName(optional_category(c, "research-papers").select(F.lit("one").alias("part"), "id"))


@query("B5_filter_score_floor", "SELECT id, significance_score FROM clusters WHERE significance_score >= 6")
def _(x):
    return x.clusters().where("significance_score >= 6").select("id", "significance_score")


@query("B6_filter_prefix", "SELECT id, source_name FROM articles WHERE source_name LIKE 'src1%'")
def _(x):
    return x.articles().where(F.col("source_name").startswith(PAPER_PREFIX)).select("id", "source_name")


@query("B7_filter_ilike_any", "SELECT id, title FROM articles WHERE title ILIKE '%hethe%' OR title ILIKE '%ouen%'")
def _(x):
    return x.articles().where(S.contains_any(F.lower("title"), ["hethe", "ouen"])).select("id", "title")


@query("B9_filter_coverage_candidates", """SELECT id FROM clusters c WHERE category <> 'uncategorized' AND (category = 'model-releases' OR significance_score >= 5)
    AND (first_published_at >= AS_OF - INTERVAL 28 DAY OR NOT EXISTS (SELECT 1 FROM model_clusters m WHERE m.cluster_id = c.id))""")
def _(x):
    linked = x.model_clusters().select(F.col("cluster_id").alias("id")).distinct().withColumn("linked", F.lit(True))
    c = x.clusters().where("category <> 'uncategorized' and (category = 'model-releases' or significance_score >= 5)").join(linked, "id", "left")
    return c.where((F.col("first_published_at") >= as_of() - F.expr("INTERVAL 28 DAYS")) | F.col("linked").isNull()).select("id")


def backfill(df: DataFrame, now, *, least: int = 300, days: int = 4) -> DataFrame:
    """Newest max(least, rows of the last days) rows. The last days' rows are themselves the newest,
    so that is them and, if there are fewer, the newest `least`: no global order is needed."""
    fresh = T.recent(df, "published_at", now, days)
    newest = T.top_k(df, least, F.col("published_at").desc(), F.col("id"))
    return fresh.unionByName(newest.join(fresh.select("id"), "id", "left_anti").select(df.columns))


@query("B10_filter_backfill_limit", """SELECT id FROM articles WHERE cluster_id IS NULL QUALIFY row_number() OVER (ORDER BY published_at DESC, id) <= (SELECT greatest(300, count(*) FILTER (WHERE published_at >= AS_OF - INTERVAL 4 DAY)) FROM articles WHERE cluster_id IS NULL)""")
def _(x):
    return backfill(x.articles().where("cluster_id is null"), as_of()).select("id")


@query("B12_validate_calendar_date", """SELECT s, CASE WHEN regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}$') AND strftime(try_cast(s AS DATE), '%Y-%m-%d') = s THEN true ELSE false END AS ok
    FROM (SELECT DISTINCT printf('2024-%02d-%02d', CAST(event_id % 14 AS INT), CAST(event_id % 33 AS INT)) AS s FROM events)""")
def _(x):
    s = F.format_string("2024-%02d-%02d", F.col("event_id") % 14, F.col("event_id") % 33)
    return x.table("events").select(s.alias("s")).distinct().withColumn("ok", S.valid_date(F.col("s")))


@query("B14_filter_financial_noise", "SELECT id, title FROM articles WHERE contains(lower(title), 'etf') OR contains(lower(title), 'sha') OR contains(lower(title), 'ined')")
def _(x):
    return x.articles().where(S.is_noise(F.col("title"), ["etf", "sha", "ined"])).select("id", "title")


@query("B15_filter_topic_relevance", "SELECT id FROM articles WHERE regexp_matches(lower(title || ' ' || coalesce(body_excerpt, '')), '\\bthat\\b') OR contains(lower(title || ' ' || coalesce(body_excerpt, '')), 'quela')")
def _(x):
    return x.articles().where(S.is_relevant(F.col("title"), F.col("body_excerpt"), ["quela"], word="that")).select("id")


@query("B18_filter_indexable", """SELECT 'story' AS kind, id AS key FROM clusters WHERE first_published_at >= AS_OF - INTERVAL 370 DAY AND (article_count >= 2 OR significance_score >= 6)
    UNION ALL SELECT 'day', CAST(CAST(first_published_at AS DATE) AS VARCHAR) FROM clusters WHERE first_published_at >= AS_OF - INTERVAL 370 DAY GROUP BY CAST(first_published_at AS DATE) HAVING count(*) >= 3
    UNION ALL SELECT 'model', CAST(id AS VARCHAR) FROM models m WHERE price_in IS NOT NULL AND (EXISTS (SELECT 1 FROM model_benchmarks b WHERE b.model_id = m.id) OR EXISTS (SELECT 1 FROM model_clusters k WHERE k.model_id = m.id))""")
def _(x):
    c = T.recent(x.clusters(), "first_published_at", as_of(), 370)
    stories = c.where("article_count >= 2 or significance_score >= 6").select(F.lit("story").alias("kind"), F.col("id").alias("key"))
    days = c.groupBy(F.to_date("first_published_at").cast("string").alias("key")).count().where("count >= 3").select(F.lit("day").alias("kind"), "key")
    known = x.benchmarks().select("model_id").unionByName(x.model_clusters().select("model_id")).distinct()
    m = x.models().where("price_in is not null")
    return stories.unionByName(days).unionByName(m.join(known, m["id"] == known["model_id"], "left_semi").select(F.lit("model").alias("kind"), F.col("id").cast("string").alias("key")))


@query("C1_join_article_cluster", "SELECT a.id, c.id AS story, c.significance_score FROM articles a JOIN clusters c ON a.cluster_id = c.id")
def _(x):
    a, c = x.articles(), x.clusters()
    return a.join(c, a["cluster_id"] == c["id"]).select(a["id"], c["id"].alias("story"), "significance_score")


@query("C2_join_top1_lateral", "SELECT s.name, a.id, a.title FROM sources s LEFT JOIN LATERAL (SELECT * FROM articles a WHERE a.source_name = s.name AND a.impact >= 9 ORDER BY authority DESC, published_at DESC, id LIMIT 1) a ON true")
def _(x):
    best = T.first_per_key(x.articles().where("impact >= 9"), ["source_name"], F.col("authority").desc(), F.col("published_at").desc(), "id")
    s = x.sources()
    return s.join(best, s["name"] == best["source_name"], "left").select(s["name"], "id", "title")


@query("C3_join_distinct_on", "SELECT DISTINCT ON (cluster_id) cluster_id, id, title FROM articles WHERE cluster_id IS NOT NULL ORDER BY cluster_id, authority DESC, published_at, id")
def _(x):
    return T.best_article(x.articles()).select("cluster_id", F.col("article_id").alias("id"), "title")


@query("C4_join_bridge_mn", "SELECT c.id, m.slug, m.released_at FROM clusters c JOIN model_clusters k ON k.cluster_id = c.id JOIN models m ON m.id = k.model_id QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY m.released_at DESC, m.id) <= 3")
def _(x):
    c, k, m = x.clusters().select("id"), x.model_clusters(), x.models().select(F.col("id").alias("model_id"), "slug", "released_at")
    j = c.join(k, c["id"] == k["cluster_id"]).join(m, "model_id")
    return T.first_per_key(j, ["id"], F.col("released_at").desc(), "model_id", k=3).select("id", "slug", "released_at")


@query("C5_semi_exists", "SELECT id FROM clusters c WHERE EXISTS (SELECT 1 FROM articles a WHERE a.cluster_id = c.id AND a.source_name NOT LIKE 'src1%')")
def _(x):
    c, a = x.clusters(), x.articles().where(~F.col("source_name").startswith(PAPER_PREFIX))
    return c.join(a, c["id"] == a["cluster_id"], "left_semi").select("id")


@query("C6_anti_not_exists", "SELECT id FROM models m WHERE NOT EXISTS (SELECT 1 FROM model_clusters k WHERE k.model_id = m.id)")
def _(x):
    m, k = x.models(), x.model_clusters()
    return m.join(k, m["id"] == k["model_id"], "left_anti").select("id")


@query("C7_in_subquery_self_semi", "SELECT DISTINCT a.cluster_id AS id, b.cluster_id AS related FROM model_clusters a JOIN model_clusters b ON a.model_id = b.model_id AND a.cluster_id <> b.cluster_id")
def _(x):
    a, b = x.model_clusters(), x.model_clusters().withColumnRenamed("cluster_id", "related")
    return a.join(b, "model_id").where("cluster_id <> related").select(F.col("cluster_id").alias("id"), "related").distinct()


#: Right rows of a block of a band join, about, and of a list; left blocks hold twice as many as right ones.
BAND_ROWS, BAND_LIST = 2048, 64


@query("C8_join_time_band", "SELECT a.id, b.id AS related FROM clusters a JOIN clusters b ON a.category = b.category AND a.id <> b.id AND abs(epoch_us(a.first_published_at) - epoch_us(b.first_published_at)) <= 4 * 86400000000")
def _(x):
    # four-day buckets make the band an equi join: a bucket meets itself and its neighbours. Those of a crowded one meet in
    # tiles, a block of left rows and one of right rows, so a row moves once for each block of the other side. Right rows go
    # in short lists, each of which meets a whole left block: pairs one after another name few ids again and again, which
    # files keep in a fraction of a byte; a whole bucket of ids for each left row would take several bytes a pair
    c = cut(x.clusters().select("id", "category", F.unix_micros("first_published_at").alias("t")))
    width = 4 * 86_400_000_000
    bucket = F.floor(F.col("t") / width)
    a = c.withColumn("bucket", F.explode(F.array(*[bucket + o for o in (-1, 0, 1)])))
    b = c.select(F.col("id").alias("related"), "category", F.col("t").alias("u"), bucket.alias("bucket"))
    count = lambda df, **rows: df.groupBy("category", "bucket").agg(*[F.ceil(F.count("*") / n).alias(k) for k, n in rows.items()])
    sizes = cut(count(a, lefts=2 * BAND_ROWS).join(count(b, rights=BAND_ROWS, lists=BAND_LIST), ["category", "bucket"]))  # a row for each category and four days
    tiles, most = sizes.agg(F.sum(F.col("lefts") * F.col("rights")), F.max(F.col("lefts") * F.col("rights"))).first()
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    keys = ["category", "bucket", "block", "other"]
    a = a.join(F.broadcast(sizes), keys[:2]).select("id", "t", *keys[:2], own("id", "lefts").alias("block"), every("rights").alias("other"))
    b = b.join(F.broadcast(sizes), keys[:2]).groupBy(*keys[:2], "lefts", "rights", own("related", "lists").alias("list")).agg(F.collect_list(F.struct("related", "u")).alias("near"))
    b = b.select("near", *keys[:2], every("lefts").alias("block"), F.pmod("list", "rights").alias("other"))
    if (most or 0) > 1:  # a task for about one tile, which adaptive plans would put together by their bytes
        tasks = min(4 * tiles, 4096)
        a, b = a.repartition(tasks, *keys), b.repartition(tasks, *keys).hint("merge")  # lists are met one by one
    pairs = b.join(a, keys).select("id", "t", F.explode("near").alias("n"))
    return pairs.where((F.col("id") != F.col("n.related")) & (F.abs(F.col("t") - F.col("n.u")) <= width)).select("id", "n.related")


@query("C12_anti_existing_url_title", """SELECT id FROM articles n WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM articles o WHERE o.id % 3 <> 0 AND o.source_url = n.source_url)
    AND NOT EXISTS (SELECT 1 FROM articles o WHERE o.id % 3 <> 0 AND o.published_at >= AS_OF - INTERVAL 7 DAY AND lower(o.source_name) = lower(n.source_name) AND lower(o.title) = lower(n.title))""")
def _(x):
    a = x.articles()
    new, old = a.where("id % 3 = 0"), a.where("id % 3 <> 0")
    return fresh_only(new, old, as_of()).select("id")


def fresh_only(new: DataFrame, old: DataFrame, now, days: int = 7) -> DataFrame:
    """Rows whose url is not stored, nor their outlet and title within the last days."""
    urls = old.select("source_url")
    titles = T.recent(old, "published_at", now, days).select(F.lower("source_name").alias("_s"), F.lower("title").alias("_t"))
    out = new.join(urls, "source_url", "left_anti")
    return out.join(titles, (F.lower("source_name") == F.col("_s")) & (F.lower("title") == F.col("_t")), "left_anti")


DAYS = "SELECT CAST(first_published_at AS DATE) AS d, count(*) AS n FROM clusters GROUP BY 1 HAVING count(*) >= 3"


def story_days(stories: DataFrame, least: int = 3) -> DataFrame:
    return stories.groupBy(F.to_date("first_published_at").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


@query("C18_adjacent_period", f"SELECT d, n, lag(d) OVER (ORDER BY d) AS before, lead(d) OVER (ORDER BY d) AS after FROM ({DAYS})")
def _(x):
    return beside(story_days(x.clusters()), [], ["d"], "d").select("d", "n", F.col("previous").alias("before"), F.col("next").alias("after"))


@query("D1_agg_cluster_meta", "SELECT cluster_id, article_count, first_published_at FROM cluster_meta")
def _(x):
    return T.cluster_meta(x.articles())


@query("D2_agg_peak_day", "SELECT cluster_id, peak_date FROM peak")
def _(x):
    return T.peak_day(x.articles())


@query("D3_agg_org_max", "SELECT cluster_id, organization, a AS authority FROM org_max")
def _(x):
    return T.org_max(x.articles())


@query("D4_agg_weighted_base", "SELECT cluster_id, round(base, 6) AS base FROM org_scores")
def _(x):
    return T.weighted_base(T.org_max(x.articles())).withColumn("base", F.round("base", 6))


@query("D5_agg_coverage_multiplier", "SELECT cluster_id, round(breadth, 6) AS breadth FROM org_scores")
def _(x):
    return T.coverage_multiplier(T.org_max(x.articles())).withColumn("breadth", F.round("breadth", 6))


@query("D6_agg_max_impact", "SELECT cluster_id, max_impact FROM cluster_meta")
def _(x):
    return T.max_impact(x.articles())


@query("D7_agg_category_majority", "SELECT cluster_id, category FROM cat_major")
def _(x):
    return T.category_majority(x.articles())


@query("D8_agg_pick_headline", "SELECT cluster_id, headline FROM headlines")
def _(x):
    return T.pick_headline(x.articles())


@query("D9_agg_bool_and", "SELECT cluster_id, paper_only FROM cluster_meta")
def _(x):
    return T.paper_only(x.articles(), PAPER_PREFIX)


@query("D10_agg_distinct_sources", "SELECT cluster_id, source_count FROM cluster_meta")
def _(x):
    return x.articles().where("cluster_id is not null").groupBy("cluster_id").agg(F.count_distinct("source_name").alias("source_count"))


@query("D11_agg_having_days", DAYS)
def _(x):
    return story_days(x.clusters())


@query("D12_agg_filtered_count", "SELECT source_name, count(*) AS n, count(*) FILTER (WHERE published_at >= AS_OF - INTERVAL 7 DAY) AS recent FROM articles GROUP BY ROLLUP (source_name)")
def _(x):
    return x.articles().rollup("source_name").agg(F.count("*").alias("n"), F.count_if(F.col("published_at") >= as_of() - F.expr("INTERVAL 7 DAYS")).alias("recent"))


@query("D20_agg_paper_dominant", "SELECT cluster_id, count(*) FILTER (WHERE source_name LIKE 'src1%') * 2 > count(*) AS dominant FROM articles WHERE cluster_id IS NOT NULL GROUP BY 1")
def _(x):
    return x.articles().where("cluster_id is not null").groupBy("cluster_id").agg((F.count_if(F.col("source_name").startswith(PAPER_PREFIX)) * 2 > F.count("*")).alias("dominant"))


@query("D22_agg_source_first_n", """SELECT cluster_id, array_to_string(list(source_name ORDER BY f), ', ') AS outlets FROM (SELECT cluster_id, source_name, min(r) AS f FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY authority DESC, published_at, id) AS r FROM articles WHERE cluster_id IS NOT NULL) WHERE r <= 3 GROUP BY 1, 2) GROUP BY 1""")
def _(x):
    top = T.top_members(x.articles(), 3).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_name"))).alias("m"))
    return top.select("cluster_id", F.array_join(F.array_distinct(F.transform("m", lambda s: s["source_name"])), ", ").alias("outlets"))


@query("D23_agg_histogram", "SELECT s.k AS score, count(c.id) AS n, round(count(c.id) / greatest(1, (SELECT count(*) FROM clusters)), 6) AS share FROM range(1, 11) s(k) LEFT JOIN clusters c ON c.significance_score = s.k GROUP BY 1")
def _(x):
    c, spine = x.clusters(), x.spark.range(1, 11).select(F.col("id").alias("score"))
    counts = c.groupBy(F.col("significance_score").cast("long").alias("score")).agg(F.count("*").alias("n"))
    total = Window.partitionBy()  # ten rows
    out = spine.join(counts, "score", "left").na.fill(0, ["n"])
    return out.withColumn("share", F.round(F.col("n") / F.greatest(F.lit(1), F.sum("n").over(total)), 6))


@query("D25_agg_run_health", "SELECT count(*) AS runs, sum(articles_ingested)::BIGINT AS articles, sum(clusters_updated)::BIGINT AS updates, max(ran_at) AS last_run, round((epoch_us(AS_OF) - epoch_us(max(ran_at))) / 3600e6, 4) AS hours_since FROM pipeline_runs")
def _(x):
    since = (F.unix_micros(as_of()) - F.unix_micros(F.max("ran_at"))) / 3600e6
    return x.pipeline_runs().agg(F.count("*").alias("runs"), F.sum("articles_ingested").alias("articles"), F.sum("clusters_updated").alias("updates"), F.max("ran_at").alias("last_run"), F.round(since, 4).alias("hours_since"))


@query("E1_win_top3_members", "SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY authority DESC NULLS LAST, published_at, id) AS rank, id FROM articles WHERE cluster_id IS NOT NULL QUALIFY rank <= 3")
def _(x):
    return T.top_members(x.articles(), 3).select("cluster_id", "rank", "id")


@query("E7_win_gap_detect", """SELECT ran_at AS gap_start, nxt AS gap_end, round((epoch_us(nxt) - epoch_us(ran_at)) / 3600e6, 4) AS hours FROM (SELECT ran_at, coalesce(lead(ran_at) OVER (ORDER BY ran_at, id), AS_OF) AS nxt FROM pipeline_runs) WHERE epoch_us(nxt) - epoch_us(ran_at) > 4 * 3600000000""")
def _(x):
    return run_gaps(x.pipeline_runs(), as_of())


def run_gaps(runs: DataFrame, now, hours: int = 4) -> DataFrame:
    """Gaps of more than `hours` between runs, and the open one up to now."""
    nxt = F.coalesce("next", now)
    out = beside(runs, [], ["ran_at", "id"], "ran_at").select(F.col("ran_at").alias("gap_start"), nxt.alias("gap_end")).withColumn("hours", (F.unix_micros("gap_end") - F.unix_micros("gap_start")) / 3600e6)
    return out.where(F.col("hours") > hours).withColumn("hours", F.round("hours", 4))


@query("F1_topk_stories", f"SELECT id, significance_score FROM clusters ORDER BY {SQL_ORDER} LIMIT 20")
def _(x):
    return T.top_k(x.clusters(), 20, *order()).select("id", "significance_score")


@query("F2_sort_papers_last", "SELECT row_number() OVER (ORDER BY paper_only, significance_score DESC, article_count DESC, first_published_at DESC, id) AS pos, id FROM clusters QUALIFY pos <= 50")
def _(x):
    keys = ("paper_only", F.col("significance_score").desc(), F.col("article_count").desc(), F.col("first_published_at").desc(), "id")
    top = T.top_k(x.clusters(), 50, *keys)
    return top.select(F.row_number().over(Window.orderBy(*keys)).alias("pos"), "id")


@query("F3_sort_by_significance", "SELECT row_number() OVER (ORDER BY coalesce(significance_score, 0) DESC, coalesce(source_count, 0) DESC, coalesce(max_impact, 0) DESC, first_published_at DESC, id) AS pos, id FROM clusters QUALIFY pos <= 50")
def _(x):
    keys = (*[F.coalesce(F.col(c), F.lit(0)).desc() for c in ("significance_score", "source_count", "max_impact")], F.col("first_published_at").desc(), "id")
    return T.top_k(x.clusters(), 50, *keys).select(F.row_number().over(Window.orderBy(*keys)).alias("pos"), "id")


AGE = "(epoch_us(AS_OF) - epoch_us(first_published_at)) / 1e6"


def age_seconds():
    return (F.unix_micros(as_of()) - F.unix_micros("first_published_at")) / 1e6


@query("F4_sort_hybrid_recency", f"SELECT id, round(significance_score / (1 + {AGE} / 86400 / 60), 6) AS rank_score FROM clusters ORDER BY rank_score DESC, id LIMIT 20 OFFSET 10")
def _(x):
    ranked = x.clusters().select("id", F.round(F.col("significance_score") / (1 + age_seconds() / 86400 / 60), 6).alias("rank_score"))
    return ranked.orderBy(F.col("rank_score").desc(), "id").offset(10).limit(20)


@query("F5_sort_decay_2day", f"SELECT id, headline FROM clusters ORDER BY round(significance_score / (1 + {AGE} / 172800), 9) DESC, first_published_at DESC, id LIMIT 3")
def _(x):
    score = F.round(F.col("significance_score") / (1 + age_seconds() / 172800), 9)
    return T.top_k(x.clusters(), 3, score.desc(), F.col("first_published_at").desc(), F.col("id")).select("id", "headline")


@query("F7_cap_newest", "SELECT count(*) FILTER (WHERE r <= 250) AS kept, count(*) FILTER (WHERE r > 250) AS deferred, min(id) FILTER (WHERE r <= 250) AS least FROM (SELECT id, row_number() OVER (ORDER BY published_at DESC, id) AS r FROM articles)")
def _(x):
    kept, deferred = cap_newest(x.articles(), 250)
    return kept.agg(F.count("*").alias("kept"), F.min("id").alias("least")).crossJoin(deferred)


def cap_newest(df: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Newest rows, and how many are deferred (one row); most <= 0: all are kept."""
    kept = df if most <= 0 else T.top_k(df, most, F.col("published_at").desc(), F.col("id"))
    deferred = df.agg((F.greatest(F.lit(0), F.count("*") - most) if most > 0 else F.lit(0)).cast("long").alias("deferred"))
    return kept, deferred


@query("F10_preserve_request_order", "SELECT min(p) AS pos, k.slug, m.id FROM (SELECT unnest(['small-ring', 'nosuch', 'small-ring']) AS slug, unnest(range(3)) AS p UNION ALL SELECT slug, 10 + row_number() OVER (ORDER BY slug DESC) FROM models QUALIFY row_number() OVER (ORDER BY slug DESC) <= 5) k JOIN models m ON m.slug = k.slug GROUP BY k.slug, m.id")
def _(x):
    m = x.models()
    asked = x.spark.createDataFrame([("small-ring", 0), ("nosuch", 1), ("small-ring", 2)], "slug string, p long")
    tail = T.top_k(m.select("slug"), 5, F.col("slug").desc())
    tail = tail.select("slug", (10 + F.row_number().over(Window.orderBy(F.col("slug").desc()))).cast("long").alias("p"))
    first = asked.unionByName(tail).groupBy("slug").agg(F.min("p").alias("pos"))
    return first.join(m, "slug").select("pos", "slug", "id")


@query("G2_union_feeds", "SELECT id, 'a' AS feed FROM articles WHERE source_name < 'src2' UNION ALL SELECT id, 'b' FROM articles WHERE source_name >= 'src2'")
def _(x):
    a = x.articles()
    return a.where("source_name < 'src2'").select("id", F.lit("a").alias("feed")).unionByName(a.where("source_name >= 'src2'").select("id", F.lit("b").alias("feed")))


HITS = "contains(lower(headline), 'thonan')"


@query("G3_union_search_hits", f"""WITH a AS (SELECT id, 0 AS part FROM clusters WHERE ({HITS} OR contains(lower(headline), 'src7')) ORDER BY {SQL_ORDER} LIMIT 100),
    n AS (SELECT * FROM articles WHERE cluster_id IS NOT NULL AND (contains(lower(source_name), 'src7') OR contains(lower(source_name), 'thonan')) ORDER BY published_at DESC, id LIMIT 500),
    b AS (SELECT cluster_id AS id, 1 AS part FROM n GROUP BY 1 ORDER BY max(published_at) DESC, id LIMIT 100)
    SELECT id, min(part) AS part FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""".replace("WITH a AS", "SELECT * FROM (WITH a AS") + ")")
def _(x):
    return T.search(x.clusters(), x.articles(), ["thonan", "src7"]).select("id", "part")


@query("G5_dedup_by_url", "SELECT min(id) AS id, source_url FROM articles GROUP BY source_url")
def _(x):
    return T.first_per_key(x.articles(), ["source_url"], "id").select("id", "source_url")


@query("G6_dedup_by_source_title", "SELECT id FROM articles QUALIFY row_number() OVER (PARTITION BY lower(source_name), lower(title) ORDER BY id) = 1")
def _(x):
    a = x.articles().withColumn("_s", F.lower("source_name")).withColumn("_t", F.lower("title"))
    return T.first_per_key(a, ["_s", "_t"], "id").select("id")


@query("I6_cluster_score", "SELECT id AS cluster_id, round(raw_score, 6) AS raw_score, significance_score FROM clusters")
def _(x):
    return x.clusters().select(F.col("id").alias("cluster_id"), F.round("raw_score", 6).alias("raw_score"), "significance_score")


@query("A16_retain_last_n", "SELECT id, ran_at FROM pipeline_runs ORDER BY ran_at DESC, id DESC LIMIT 100")
def _(x):
    return T.top_k(x.pipeline_runs(), 100, F.col("ran_at").desc(), F.col("id").desc()).select("id", "ran_at")


@query("A10_sink_insert_ignore", "SELECT min(id) AS id, source_url FROM articles WHERE id % 2 = 1 AND source_url NOT IN (SELECT source_url FROM articles WHERE id % 2 = 0) GROUP BY source_url UNION ALL SELECT id, source_url FROM articles WHERE id % 2 = 0")
def _(x):
    from lodestory.sources.sinks import insert_ignore

    a = x.articles().select("id", "source_url")
    return insert_ignore(a.where("id % 2 = 0"), a.where("id % 2 = 1"), "source_url", "id")


@query("A17_sink_conditional_upsert", """SELECT email, source, stack FROM (SELECT lower(email) AS email, coalesce(arg_min(source, event_id) FILTER (WHERE source LIKE 'digest%'), arg_min(source, event_id)) AS source,
    coalesce(arg_max(stack, event_id) FILTER (WHERE stack IS NOT NULL AND event_id <= coalesce(f, 9223372036854775807)), NULL) AS stack
    FROM (SELECT *, min(event_id) FILTER (WHERE source LIKE 'digest%') OVER (PARTITION BY lower(email)) AS f0 FROM waitlist) w, LATERAL (SELECT CASE WHEN f0 IS NOT NULL THEN f0 END AS f) GROUP BY lower(w.email))""")
def _(x):
    from lodestory.sources.sinks import fold_waitlist

    return fold_waitlist(x.waitlist())


@query("A18_reset_window_assignments", """SELECT 'member' AS part, CAST(id AS VARCHAR) AS key, CASE WHEN published_at < TIMESTAMP '2024-01-04 00:00:00' - INTERVAL 48 HOUR THEN cluster_id END AS story, CAST(NULL AS BIGINT) AS article_count, CAST(NULL AS TIMESTAMP) AS first_published_at, CAST(NULL AS DATE) AS peak_date FROM articles
    UNION ALL SELECT 'story', cluster_id, NULL, sum(n)::BIGINT, min(f), arg_min(day, (-n, day)) FROM (SELECT cluster_id, CAST(published_at AS DATE) AS day, count(*) AS n, min(published_at) AS f FROM articles WHERE cluster_id IS NOT NULL AND published_at < TIMESTAMP '2024-01-04 00:00:00' - INTERVAL 48 HOUR GROUP BY ALL) GROUP BY cluster_id""")
def _(x):
    from lodestory.sources.sinks import reset_assignments

    members, stories = reset_assignments(x.articles(), F.lit("2024-01-04").cast("timestamp"), 48)
    rows = members.select(F.lit("member").alias("part"), F.col("id").cast("string").alias("key"), F.col("cluster_id").alias("story"))
    left = stories.select(F.lit("story").alias("part"), F.col("id").alias("key"), "article_count", "first_published_at", "peak_date")
    return rows.unionByName(left, allowMissingColumns=True)


@query("A19_delete_set_null", "SELECT id, CASE WHEN cluster_id IN (SELECT id FROM clusters WHERE significance_score >= 6) THEN cluster_id END AS cluster_id FROM articles")
def _(x):
    from lodestory.sources.sinks import delete_set_null

    gone = x.clusters().where("significance_score < 6").select(F.col("id").alias("cluster_id"))
    return delete_set_null(x.articles().select("id", "cluster_id"), gone, "cluster_id")


@query("A19_delete_cascade", "SELECT model_id, cluster_id FROM model_clusters WHERE cluster_id IN (SELECT id FROM clusters WHERE significance_score >= 6)")
def _(x):
    gone = x.clusters().where("significance_score < 6").select(F.col("id").alias("cluster_id"))
    return x.model_clusters().join(gone, "cluster_id", "left_anti")


BEST = "best AS (SELECT cluster_id, id AS article_id, source_name, source_url FROM articles WHERE cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY authority DESC NULLS LAST, published_at, id) = 1)"
BEST_SQL = BEST[len("best AS (") : -1]


STRIPPED = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({0}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))"
CONTROL_SQL = r"regexp_replace({0}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"


@query("A20_export_story_feed", f"""SELECT trim({CONTROL_SQL.format("headline")}) AS title, 'https://news.example/story/' || c.id || CASE WHEN slug <> '' THEN '/' || slug ELSE '' END AS source_url, {STRIPPED.format(CONTROL_SQL.format("(a.body_excerpt || ' (Source: ' || a.source_url || ')')"))} AS body_excerpt, date_trunc('second', first_published_at) AS published_at
    FROM (SELECT *, regexp_replace(substr(trim(regexp_replace(lower(headline), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-+$', '') AS slug FROM clusters WHERE first_published_at >= AS_OF - INTERVAL 400 DAY AND significance_score >= 5 ORDER BY first_published_at DESC, id LIMIT 50) c
    JOIN best b ON b.cluster_id = c.id JOIN articles a ON a.id = b.article_id""", best=BEST_SQL)
def _(x):
    """The feed is written, a folder per day, and read again as any outlet's feed."""
    from lodestory.sources.feeds import story_items, write_feed
    from lodestory.sources.scans import scan_feed

    items = story_items(x.clusters(), x.articles(), as_of(), site="https://news.example", days=400)
    rows = scan_feed(x.spark, write_feed(items, scratch(x.spark)))
    return rows.select("title", "source_url", "body_excerpt", "published_at")


@query("A21_export_snapshot_nested", "SELECT cluster_id AS id, array_to_string(list(id ORDER BY id), ',') AS members FROM articles WHERE cluster_id IS NOT NULL GROUP BY 1")
def _(x):
    nested = snapshot(x.articles())
    return nested.select("id", F.array_join(F.transform("members", lambda m: m["id"].cast("string")), ",").alias("members"))


def snapshot(articles: DataFrame) -> DataFrame:
    """One row per story with its members as an array of structs, in order of id."""
    return articles.where("cluster_id is not null").groupBy(F.col("cluster_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "title", "source_name", "published_at"))).alias("members"))


@query("A22_export_label_sheet")
def _(x):
    """At most 100 stories to label, those of several articles first, then single ones in the order of a
    hash; with the titles of their members, joined by a double bar, and an empty label."""
    c = x.clusters()
    many = T.top_k(c.where("article_count >= 2"), 100, *order())
    few = T.top_k(c.where("article_count < 2"), 100, F.xxhash64("id", F.lit(7)))
    both = many.withColumn("part", F.lit(0)).unionByName(few.withColumn("part", F.lit(1)))
    sheet = T.top_k(both, 100, F.col("part"), F.col("significance_score").desc(), F.col("id"))
    # titles of the members of at most 100 stories
    members = x.articles().join(sheet.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    titles = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("t"))
    line = F.array_join(F.transform("t", lambda m: m["title"]), " || ")
    out = sheet.join(titles, sheet["id"] == titles["cluster_id"])
    return out.select("id", F.col("significance_score").alias("score"), "article_count", "headline", line.alias("member_titles"), F.lit("").alias("label"))


@query("M1_top_stories", "SELECT c.id, headline, category, significance_score, article_count, b.article_id, b.source_name FROM clusters c LEFT JOIN best b ON b.cluster_id = c.id WHERE first_published_at >= AS_OF - INTERVAL 30 DAY ORDER BY significance_score DESC, first_published_at DESC, c.id LIMIT 6", best=BEST_SQL)
def _(x):
    return top_stories(x)


def top_stories(x: Fixtures, days: int = 30, limit: int = 6) -> DataFrame:
    top = T.top_k(T.recent(x.clusters(), "first_published_at", as_of(), days), limit, *order())
    return top.select("id", "headline", "category", "significance_score", "article_count", F.col("best_id").alias("article_id"), F.col("best_source").alias("source_name"))


@query("M2_recap", "SELECT CAST(c.first_published_at AS DATE) AS day, c.id, a.rank, a.id AS article_id FROM (SELECT * FROM clusters WHERE significance_score >= 6 AND first_published_at >= AS_OF - INTERVAL 30 DAY ORDER BY significance_score DESC, first_published_at DESC, id LIMIT 40) c JOIN (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY authority DESC NULLS LAST, published_at, id) AS rank FROM articles WHERE cluster_id IS NOT NULL QUALIFY rank <= 3) a ON a.cluster_id = c.id")
def _(x):
    top = T.top_k(T.recent(x.clusters(), "first_published_at", as_of(), 30).where("significance_score >= 6"), 40, *order())
    a = T.top_members(x.articles(), 3).select("cluster_id", "rank", F.col("id").alias("article_id"))
    return top.join(a, top["id"] == a["cluster_id"]).select(F.to_date("first_published_at").alias("day"), "id", "rank", "article_id")


@query("M3_model_releases", "SELECT c.id, headline, a.id AS article_id FROM (SELECT * FROM clusters WHERE significance_score > 0 AND category = 'research-papers' AND first_published_at >= AS_OF - INTERVAL 60 DAY ORDER BY first_published_at DESC, id LIMIT 50) c JOIN (SELECT cluster_id, id FROM articles WHERE cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY authority DESC NULLS LAST, published_at, id) <= 3) a ON a.cluster_id = c.id")
def _(x):
    c = optional_category(T.recent(x.clusters(), "first_published_at", as_of(), 60).where("significance_score > 0"), "research-papers")
    top = T.top_k(c, 50, F.col("first_published_at").desc(), F.col("id"))
    a = T.top_members(x.articles(), 3).select("cluster_id", F.col("id").alias("article_id"))
    return top.join(a, top["id"] == a["cluster_id"]).select("id", "headline", "article_id")


@query("M4_day_stories", f"SELECT c.id, headline, paper_only, significance_score, article_count, source_count, max_impact, (SELECT count(*) FROM (SELECT DISTINCT model_id FROM model_clusters k WHERE k.cluster_id = c.id) z) AS n_models FROM clusters c WHERE peak_date = DATE '{DAY}' ORDER BY paper_only, significance_score DESC, article_count DESC, first_published_at DESC, c.id LIMIT 50")
def _(x):
    c = x.clusters().where(F.col("peak_date") == F.lit(DAY).cast("date"))
    top = T.top_k(c, 50, F.col("paper_only"), F.col("significance_score").desc(), F.col("article_count").desc(), F.col("first_published_at").desc(), F.col("id"))
    n = x.model_clusters().groupBy("cluster_id").agg(F.count("*").alias("n_models"))
    return top.join(n, top["id"] == n["cluster_id"], "left").select("id", "headline", "paper_only", "significance_score", "article_count", "source_count", "max_impact", F.coalesce("n_models", F.lit(0)).alias("n_models"))


ONE = "SELECT * FROM clusters ORDER BY article_count DESC, id LIMIT 1"
LONE = "SELECT * FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM model_clusters k WHERE k.cluster_id = c.id) ORDER BY article_count DESC, id LIMIT 1"


def _story_sql(page: str, one: str) -> str:
    return f"""SELECT * FROM (WITH one AS ({one}), facts AS (SELECT count(DISTINCT source_name) AS sources, max(impact) AS impact FROM articles WHERE cluster_id = (SELECT id FROM one)),
    shared AS (SELECT DISTINCT b.cluster_id AS id FROM one JOIN model_clusters a ON a.cluster_id = one.id JOIN model_clusters b ON b.model_id = a.model_id WHERE b.cluster_id <> one.id),
    near AS (SELECT c.id FROM clusters c, one WHERE NOT EXISTS (FROM shared) AND c.id <> one.id AND c.category = one.category AND abs(epoch_us(c.first_published_at) - epoch_us(one.first_published_at)) <= 4 * 86400000000),
    related AS (SELECT * FROM clusters WHERE id IN (FROM shared) OR id IN (FROM near) ORDER BY {SQL_ORDER} LIMIT 4)
    SELECT '{page}' AS page, 'story' AS part, 1::BIGINT AS pos, id AS key, concat_ws('|', headline, category, significance_score, article_count, sources, impact) AS text FROM one, facts
    UNION ALL SELECT '{page}', 'member', row_number() OVER (ORDER BY authority DESC NULLS LAST, published_at, id), CAST(id AS VARCHAR), title FROM articles WHERE cluster_id = (SELECT id FROM one)
    UNION ALL SELECT * FROM (SELECT '{page}', 'model', row_number() OVER (ORDER BY released_at DESC NULLS LAST, id) AS pos, slug, name FROM models WHERE id IN (SELECT model_id FROM model_clusters WHERE cluster_id = (SELECT id FROM one))) WHERE pos <= 3
    UNION ALL SELECT '{page}', 'related', row_number() OVER (ORDER BY {SQL_ORDER}), id, headline FROM related)"""


LOST = "SELECT min(id) FROM articles WHERE cluster_id IS NULL"


@query("M5_story_detail", f"""{_story_sql("largest", ONE)} UNION ALL {_story_sql("without models", LONE)}
    UNION ALL SELECT 'article', 'story', 1, CAST(id AS VARCHAR), concat_ws('|', title, category, 0.0, 1, 1, impact) FROM articles WHERE id = ({LOST}) UNION ALL SELECT 'article', 'member', 1, CAST(id AS VARCHAR), title FROM articles WHERE id = ({LOST}) UNION ALL SELECT 'unknown', 'missing', 0, 'nosuch', NULL""")
def _(x):
    """The pages of the largest story, of the largest that names no model, of an article without a story, and of an id
    that nothing has."""
    a = cut(x.articles().drop("body_excerpt", "lang", "ai_filter"))
    c, k, m = cut(T.story_table(a)), cut(x.model_clusters()), cut(x.models().select("id", "slug", "name", "released_at"))
    largest = lambda df: T.top_k(df, 1, F.col("article_count").desc(), F.col("id")).select("id").first()
    lost = a.where("cluster_id is null").agg(F.min("id")).first()[0]
    lone = c.join(k, c["id"] == k["cluster_id"], "left_anti")
    asked = ({} if lost is None else {"article": str(lost)}) | {"unknown": "nosuch"} | {page: found["id"] for page, found in (("largest", largest(c)), ("without models", largest(lone))) if found}
    return reduce(DataFrame.unionByName, [story_page(c, a, k, m, key).withColumn("page", F.lit(page)) for page, key in asked.items()])


def story_page(stories: DataFrame, articles: DataFrame, links: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """part, pos, key, text of one page: the story (headline, category, score, articles, outlets, highest impact), its
    members, its three newest models, and four related stories: those that share a model, else those of its category
    within four days. A key that is an article's stands for a story of it alone; one that nothing has gives
    a single row, `missing`. The story is read first, so that every other read is for one key."""
    part = lambda df, name, pos, ident, text: df.select(F.lit(name).alias("part"), pos.cast("long").alias("pos"), ident.cast("string").alias("key"), text.alias("text"))
    line = lambda *order: F.row_number().over(Window.orderBy(*order))  # noqa: E731  (rows of one page)
    facts = lambda *cols: F.concat_ws("|", *[c.cast("string") for c in cols])
    one = stories.where(F.col("id") == key).select("category", "first_published_at").first()
    if one is None:
        a = articles.where(F.col("id").cast("string") == key)
        found = part(a, "story", F.lit(1), F.col("id"), facts(F.col("title"), F.coalesce("category", F.lit("uncategorized")), F.lit(0.0), F.lit(1), F.lit(1), F.col("impact")))
        found = found.unionByName(part(a, "member", F.lit(1), F.col("id"), F.col("title")))
        missing = articles.sparkSession.createDataFrame([("missing", 0, key, None)], found.schema)
        return found if a.limit(1).count() else missing
    own = articles.where(F.col("cluster_id") == key)
    outlets = own.agg(F.count_distinct("source_name").alias("sources"), F.max("impact").alias("impact"))
    story = stories.where(F.col("id") == key).crossJoin(F.broadcast(outlets))  # one row each
    mine = links.where(F.col("cluster_id") == key).select("model_id").distinct()
    named = T.top_k(models.join(mine, models["id"] == mine["model_id"], "left_semi").select("id", "slug", "name", "released_at"), 3, F.col("released_at").desc_nulls_last(), F.col("id"))
    shared = links.where(F.col("cluster_id") != key).join(mine, "model_id", "left_semi").select(F.col("cluster_id").alias("id")).distinct()
    related = T.top_k(stories.join(shared, "id", "left_semi"), 4, *order())
    if not related.limit(1).count():
        days = F.abs(F.unix_micros("first_published_at") - F.unix_micros(F.lit(one["first_published_at"]))) <= 4 * 86_400_000_000
        related = T.top_k(stories.where((F.col("category") == one["category"]) & (F.col("id") != key) & days), 4, *order())
    rows = [
        part(story, "story", F.lit(1), F.col("id"), facts(*map(F.col, ("headline", "category", "significance_score", "article_count", "sources", "impact")))),
        part(own, "member", line(F.col("authority").desc_nulls_last(), "published_at", "id"), F.col("id"), F.col("title")),
        part(named, "model", line(F.col("released_at").desc_nulls_last(), "id"), F.col("slug"), F.col("name")),
        part(related, "related", line(*order()), F.col("id"), F.col("headline")),
    ]
    return reduce(DataFrame.unionByName, rows)


#: Searches that meet both branches: plain words, an outlet with days, alternatives with a phrase and an exclusion
#: in one category, and synonyms of a whole query. Each has its words in SQL too.
SEARCHES = {
    "words": ({"query": "the and", "offset": 2, "limit": 20}, ["has(h, 'the') AND has(h, 'and')"], ["the and"], "true"),
    "outlet": ({"query": "src7", "date_from": "2024-01-02", "date_to": "2024-01-05"}, ["has(h, 'src7')"], ["src7"], "{t} >= TIMESTAMP '2024-01-02' AND {t} < TIMESTAMP '2024-01-06'"),
    "alternatives": ({"query": '"in the" OR de -la', "category": "research-papers"}, ["has(h, 'in the')", "has(h, 'de') AND NOT has(h, 'la')"], ['"in the" or de -la'], "true"),
    "synonyms": ({"query": "Eriner", "synonyms": {"eriner": ["src3", "of the"]}, "limit": 50}, ["has(h, 'eriner')", "has(h, 'src3')", "has(h, 'of the')"], ["eriner", "src3", "of the"], "true"),
}


def _search_sql(name: str) -> str:
    asked, wanted, outlets, days = SEARCHES[name]
    fit = days.format(t="first_published_at") + (f" AND category = '{asked['category']}'" if "category" in asked else "")
    named = " OR ".join(f"contains(lower(source_name), '{o}')" for o in outlets)
    words = " OR ".join(f"({w})" for w in wanted)
    for phrase in dict.fromkeys(re.findall(r"has\(h, '[^']*'\)", words)):
        words = words.replace(phrase, f"contains(h, ' {phrase[8:-2]} ')")
    return f"""SELECT * FROM (WITH s AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(headline), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS h FROM clusters WHERE {fit}),
    a AS (SELECT * FROM s WHERE {words} ORDER BY {SQL_ORDER} LIMIT 100),
    n AS (SELECT DISTINCT cluster_id FROM (SELECT cluster_id FROM articles WHERE cluster_id IS NOT NULL AND ({named}) AND {days.format(t="published_at")} ORDER BY published_at DESC, id LIMIT 500)),
    b AS (SELECT * FROM s WHERE id IN (FROM n) AND id NOT IN (SELECT id FROM a) ORDER BY {SQL_ORDER} LIMIT 100),
    page AS (SELECT id, round(significance_score / (1 + {AGE} / 86400 / 60), 6) AS rank_score, row_number() OVER (ORDER BY round(significance_score / (1 + {AGE} / 86400 / 60), 6) DESC, id) - {asked.get("offset", 0)} AS pos FROM (FROM a UNION ALL FROM b))
    SELECT '{name}' AS search, pos, id, rank_score, (SELECT string_agg(m.id, ',' ORDER BY m.r) FROM (SELECT id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY authority DESC NULLS LAST, published_at, id) AS r FROM articles) m WHERE m.cluster_id = page.id AND r <= 3) AS articles FROM page WHERE pos BETWEEN 1 AND {asked.get("limit", 20)})"""


@query("M6_search", " UNION ALL ".join(map(_search_sql, SEARCHES)))
def _(x):
    from lodestory.operators.search import search_page, write_postings

    c, a = cut(x.clusters()), cut(x.articles().select("id", "cluster_id", "title", "source_name", "published_at", "authority"))
    index = write_postings(c)
    pages = [search_page(c, a, index, now=as_of(), **asked).select(F.lit(name).alias("search"), F.col("pos").cast("long").alias("pos"), "id", "rank_score", F.array_join(F.transform("articles", lambda m: m["id"].cast("string")), ",").alias("articles")) for name, (asked, *_) in SEARCHES.items()]
    return reduce(DataFrame.unionByName, pages)


@query("M7_last_ingested", "SELECT max(published_at) AS last FROM articles")
def _(x):
    return x.articles().agg(F.max("published_at").alias("last"))


@query("M16_weekly_metrics", """SELECT 'source' AS part, coalesce(source_name, 'total') AS key, n AS value FROM (SELECT source_name, count(*) FILTER (WHERE published_at >= AS_OF - INTERVAL 30 DAY) AS n FROM articles GROUP BY ROLLUP (source_name))
    UNION ALL SELECT 'runs', 'runs', count(*) FROM pipeline_runs UNION ALL SELECT 'gaps', 'gaps', count(*) FROM (SELECT ran_at, coalesce(lead(ran_at) OVER (ORDER BY ran_at, id), AS_OF) AS nxt FROM pipeline_runs) WHERE epoch_us(nxt) - epoch_us(ran_at) > 4 * 3600000000""")
def _(x):
    a = x.articles().rollup("source_name").agg(F.count_if(F.col("published_at") >= as_of() - F.expr("INTERVAL 30 DAYS")).alias("value"))
    rows = a.select(F.lit("source").alias("part"), F.coalesce("source_name", F.lit("total")).alias("key"), "value")
    runs = x.pipeline_runs().agg(F.count("*").alias("value")).select(F.lit("runs").alias("part"), F.lit("runs").alias("key"), "value")
    gaps = run_gaps(x.pipeline_runs(), as_of()).agg(F.count("*").alias("value")).select(F.lit("gaps").alias("part"), F.lit("gaps").alias("key"), "value")
    return rows.unionByName(runs).unionByName(gaps)


@query("M17_digest_material", f"SELECT id, headline, source_count, article_count FROM clusters WHERE first_published_at >= AS_OF - INTERVAL 30 DAY AND category <> 'research-papers' ORDER BY {SQL_ORDER} LIMIT 8")
def _(x):
    c = T.recent(x.clusters(), "first_published_at", as_of(), 30).where("category <> 'research-papers'")
    return T.top_k(c, 8, *order()).select("id", "headline", "source_count", "article_count")


@query("M18_substantive_days", f"SELECT d, n, lag(d) OVER (ORDER BY d) AS before, lead(d) OVER (ORDER BY d) AS after FROM (SELECT CAST(first_published_at AS DATE) AS d, count(*) AS n FROM clusters WHERE NOT paper_only GROUP BY 1 HAVING count(*) >= 3)")
def _(x):
    c, a = x.clusters(), x.articles().where(~F.col("source_name").startswith(PAPER_PREFIX))
    days = story_days(c.join(a, c["id"] == a["cluster_id"], "left_semi"))
    return beside(days, [], ["d"], "d").select("d", "n", F.col("previous").alias("before"), F.col("next").alias("after"))


@query("M19_index_candidates", f"SELECT 'model' AS part, slug AS key, CAST(released_at AS TIMESTAMP) AS at FROM models UNION ALL SELECT * FROM (SELECT 'story', id, first_published_at FROM clusters WHERE first_published_at >= AS_OF - INTERVAL 370 DAY AND (article_count >= 2 OR significance_score >= 6) ORDER BY first_published_at DESC, id LIMIT 3000)")
def _(x):
    c = T.recent(x.clusters(), "first_published_at", as_of(), 370).where("article_count >= 2 or significance_score >= 6")
    stories = T.top_k(c, 3000, F.col("first_published_at").desc(), F.col("id")).select(F.lit("story").alias("part"), F.col("id").alias("key"), F.col("first_published_at").alias("at"))
    models = x.models().select(F.lit("model").alias("part"), F.col("slug").alias("key"), F.col("released_at").cast("timestamp").alias("at"))
    return models.unionByName(stories)


@query("M25_pending_scoring_batches", """SELECT id, batch, CASE batch % 5 WHEN 3 THEN 5 WHEN 4 THEN NULL ELSE CASE WHEN id % 4 <> 0 THEN least(10, greatest(1, id % 14 - 1)) END END AS impact FROM (SELECT id, (row_number() OVER (ORDER BY published_at DESC, id) - 1) // 10 AS batch, row_number() OVER (ORDER BY published_at DESC, id) AS r FROM articles WHERE impact IS NULL)
    WHERE r <= (SELECT greatest(300, count(*) FILTER (WHERE published_at >= AS_OF - INTERVAL 4 DAY)) FROM articles WHERE impact IS NULL)""")
def _(x):
    """Of five answers of the rater one is no JSON and one is missing; some rows have no verdict."""
    batches = cut(scoring_batches(backfill(x.articles().where("impact is null"), as_of())))
    verdict = F.when(F.col("id") % 4 != 0, F.struct(F.col("id").cast("string").alias("id"), (F.col("id") % 14 - 1).alias("score")))
    said = F.concat(F.lit("```json\n"), F.to_json(F.collect_list(verdict)), F.lit("\n```"))
    answers = batches.groupBy("batch").agg(said.alias("answer"))
    kind = F.col("batch") % 5
    return rated(batches, answers.withColumn("answer", F.when(kind == 3, "I can't rate these.").when(kind != 4, F.col("answer"))))


def scoring_batches(pending: DataFrame, size: int = 10) -> DataFrame:
    """id, batch: numbered groups of pending rows, newest first. Rows are numbered day by day, days by their
    counts (a row a day)."""
    day = pending.withColumn("day", F.to_date("published_at"))
    days = day.groupBy("day").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.col("day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(F.col("day").alias("_day"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.col("published_at").desc(), "id"))
    rows = day.withColumn("place", place).join(days, F.col("day").eqNullSafe(F.col("_day")))
    return rows.select("id", F.floor((F.col("before") + F.col("place") - 1) / size).alias("batch"))


def rated(batches: DataFrame, answers: DataFrame, neutral: int = 5) -> DataFrame:
    """id, batch, impact from a rater's answers (batch, answer: a JSON array of id and score, fenced or not). Scores
    are cut to 1..10; a row that the array leaves out has none. An answer that can't be read gives
    its whole batch the neutral score; a batch without an answer stays unrated, to be tried again."""
    text = F.regexp_replace(F.trim("answer"), r"^```(?:json)?\s*|\s*```[\s\S]*$", "")
    verdicts = F.from_json(text, "array<struct<id:string,score:string>>")
    whole = F.coalesce(text.startswith("[") & F.forall(verdicts, lambda v: v["id"].isNotNull() & F.coalesce(v["score"].rlike(r"^\s*-?\d+(\.\d+)?\s*$"), F.lit(False))), F.lit(False))
    read = answers.where("answer is not null").select(F.col("batch").alias("_batch"), F.when(whole, verdicts).alias("verdicts"))
    rows = batches.join(read.withColumn("_answered", F.lit(True)), F.col("batch") == F.col("_batch"), "left")
    own = F.filter("verdicts", lambda v: v["id"] == F.col("id").cast("string"))
    score = F.try_element_at(own, F.lit(-1))["score"].cast("double").cast("int")
    impact = F.when(F.col("_answered") & F.col("verdicts").isNull(), neutral).when(score.isNotNull(), F.least(F.lit(10), F.greatest(F.lit(1), score)))
    return rows.select("id", "batch", impact.alias("impact"))


@query("M26_pending_summaries", f"SELECT c.id, a.id AS article_id FROM (SELECT * FROM clusters WHERE significance_score >= 4 AND first_published_at >= AS_OF - INTERVAL 40 DAY ORDER BY {SQL_ORDER} LIMIT 150) c JOIN (SELECT cluster_id, id FROM articles WHERE cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY authority DESC NULLS LAST, published_at, id) <= 3) a ON a.cluster_id = c.id")
def _(x):
    c = T.top_k(T.recent(x.clusters(), "first_published_at", as_of(), 40).where("significance_score >= 4"), 150, *order())
    a = T.top_members(x.articles(), 3).select("cluster_id", F.col("id").alias("article_id"))
    return c.join(a, c["id"] == a["cluster_id"]).select("id", "article_id")
