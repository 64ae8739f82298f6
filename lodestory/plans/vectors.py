"""Queries over article vectors, story merging and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestory.functions import scalars as S
from lodestory.operators import vectors as X
from lodestory.operators.graph import connected_components
from lodestory.operators.stories import cluster_score, recent, story_table, top_k
from lodestory.plans.catalog import query
from lodestory.shipping import ship
from lodestory.sources.fixtures import BAND, NEWS, PAPER, PAPER_PREFIX, WINDOW_HOURS, Fixtures, as_of
from lodestory.storage import cut

#: Scores from which a story is in a tier.
TIER_HIGH, TIER_NOTABLE = 8.5, 7.0
DIST = "1 - list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
OWN = {
    "vec": "SELECT id, epoch_us(published_at) AS t, source_name, cluster_id, vector::DOUBLE[] AS v FROM vectors",
    "near_all": f"SELECT a.id, b.id AS other, a.cluster_id AS ca, b.cluster_id AS cb, a.source_name AS sa, {DIST.format('a.v', 'b.v')} AS d FROM vec a JOIN vec b ON a.id <> b.id AND abs(a.t - b.t) <= 172800000000",
    "knn": "SELECT id, other, d, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM near_all WHERE d < CASE WHEN sa LIKE 'src1%' THEN 0.55 ELSE 0.60 END QUALIFY rank <= 10",
    "cent": "SELECT cluster_id, list(x ORDER BY p) AS v FROM (SELECT cluster_id, p, avg(v[p]) AS x FROM vec, range(1, 65) r(p) WHERE cluster_id IS NOT NULL GROUP BY ALL) GROUP BY 1",
    "points": "SELECT c.cluster_id AS id, c.v, t, size, paper FROM cent c JOIN (SELECT cluster_id, min(t) AS t, count(*) AS size, count(*) FILTER (WHERE source_name LIKE 'src1%') * 2 > count(*) AS paper FROM vec WHERE cluster_id IS NOT NULL GROUP BY 1) USING (cluster_id)",
    "point_pairs": f"SELECT a.id AS a, b.id AS b, a.paper AS pa, b.paper AS pb, {DIST.format('a.v', 'b.v')} AS d FROM points a JOIN points b ON a.id < b.id AND abs(a.t - b.t) <= 172800000000",
    "close": "SELECT a, b, d FROM point_pairs WHERE d < CASE WHEN pa AND pb THEN 0.55 ELSE 0.60 END",
    "band": "SELECT a, b, d FROM point_pairs WHERE NOT pa AND NOT pb AND d >= 0.60 AND d < 0.65 ORDER BY d, a, b LIMIT 60",
    "links": "SELECT a, b FROM close UNION SELECT b, a FROM close",
    "reach": "SELECT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen",
    "comps": "SELECT node, min(seen) AS label FROM reach GROUP BY 1",
}


def q(name: str, sql: str | None = None, **more: str):
    return query(name, sql, **OWN, **more)


def threshold():
    return S.effective_threshold(F.col("source_name"), paper_prefix=PAPER_PREFIX, news=NEWS, paper=PAPER)


def points(x: Fixtures):
    return X.story_points(x.vectors(), PAPER_PREFIX)


def close(x: Fixtures):
    return X.close_pairs(points(x), news=NEWS, paper=PAPER, hours=WINDOW_HOURS)


@q("C9_knn_window_join", "SELECT id, other, round(d, 6) AS d FROM knn")
def _(x):
    return X.knn_window(x.vectors(), threshold(), hours=WINDOW_HOURS).select("id", "other", F.round("d", 6).alias("d"))


@q("E9_win_knn_rank", "SELECT id, other, rank FROM knn")
def _(x):
    return X.knn_window(x.vectors(), threshold(), hours=WINDOW_HOURS).select("id", "other", "rank")


@q("C14_pair_self_theta", "SELECT a, b, round(d, 6) AS d FROM close")
def _(x):
    return close(x).withColumn("d", F.round("d", 6))


@q("D19_agg_centroid", "SELECT cluster_id, round(v[1], 6) AS first, round(v[64], 6) AS last, round(sqrt(list_dot_product(v, v)), 6) AS length FROM cent")
def _(x):
    c = X.centroids(x.vectors())
    return c.select("cluster_id", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"), F.round(S.norm(F.col("vector")), 6).alias("length"))


INTRA = f"SELECT a.cluster_id, max({DIST.format('a.v', 'b.v')}) AS max_d FROM vec a JOIN vec b ON a.cluster_id = b.cluster_id AND a.id < b.id GROUP BY 1"


@q("D24_agg_intra_cluster_max_dist", "SELECT cluster_id, round(max_d, 6) AS max_d FROM intra", intra=INTRA)
def _(x):
    return X.intra_max(x.vectors()).withColumn("max_d", F.round("max_d", 6))


@q("I7_false_merge_suspects", "SELECT cluster_id, round(max_d, 6) AS max_d FROM intra WHERE max_d > 1.0", intra=INTRA)
def _(x):
    return X.intra_max(x.vectors()).where("max_d > 1.0").withColumn("max_d", F.round("max_d", 6))


@q("I1_greedy_cluster")
def _(x):
    ship(x.spark)
    return X.greedy_cluster(x.vectors(), threshold(), hours=WINDOW_HOURS)


@q("I2_merge_close_clusters", "SELECT p.id AS old, first_value(p.id) OVER (PARTITION BY coalesce(c.label, p.id) ORDER BY p.size DESC, p.t, p.id) AS new FROM points p LEFT JOIN comps c ON c.node = p.id")
def _(x):
    p = cut(points(x))
    return X.merge_stories(p, X.close_pairs(p, news=NEWS, paper=PAPER, hours=WINDOW_HOURS).select("a", "b"))


@q("I3_connected_components", "SELECT node, label FROM comps")
def _(x):
    return connected_components(close(x))


@q("I4_ambiguous_pairs", "SELECT a, b, round(d, 6) AS d FROM band")
def _(x):
    return X.ambiguous_pairs(points(x), low=NEWS, high=BAND, hours=WINDOW_HOURS).withColumn("d", F.round("d", 6))


@q("I5_apply_confirmed_pairs", "SELECT a, b, (length(a) + length(b)) % 2 = 0 AS same FROM band")
def _(x):
    pairs = cut(X.ambiguous_pairs(points(x), low=NEWS, high=BAND, hours=WINDOW_HOURS))
    verdicts = pairs.where((F.length("a") + F.length("b")) % 2 == 0).select("a", "b", F.lit(True).alias("same"))
    return X.apply_verdicts(pairs, verdicts).select("a", "b", "same")


@q("I8_missed_merge_suspects", "SELECT ca AS a, cb AS b, round(min(d), 6) AS d FROM near_all WHERE ca < cb AND d < 0.60 GROUP BY ALL")
def _(x):
    return X.missed_merges(x.vectors(), threshold=NEWS, hours=WINDOW_HOURS).withColumn("d", F.round("d", 6))


@q("I9_recluster_compare")
def _(x):
    """What the greedy rule would make of all articles: old stories split or kept, and the new ones' totals and scores."""
    v, a = x.vectors(), x.articles()
    new = cut(X.greedy_cluster(v, threshold(), hours=WINDOW_HOURS).withColumn("story", F.col("story").cast("string")))
    return recluster_report(a, v, new)


def recluster_report(articles: DataFrame, vectors: DataFrame, new: DataFrame, least: float = 0.20, high: float = TIER_HIGH) -> DataFrame:
    """part, key, value: new stories per old one; articles, stories, those of several articles, those with two papers or
    more, false-merge suspects (spread over the strictest member's threshold and `least`), and the histogram of scores."""
    old = vectors.where("cluster_id is not null").select("id", F.col("cluster_id").alias("old"))
    again = articles.drop("cluster_id").join(new.withColumnRenamed("story", "cluster_id"), "id")
    scores = cut(cluster_score(again))
    paper = F.col("source_name").startswith(PAPER_PREFIX)
    sizes = again.withColumn("thr", threshold()).groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_if(paper).alias("papers"), F.min("thr").alias("thr"))
    spread = X.intra_max(vectors.drop("cluster_id").join(new.withColumnRenamed("story", "cluster_id"), "id"))
    stories = cut(sizes.join(spread, "cluster_id", "left"))
    count = lambda name, test: F.count_if(test).cast("double").alias(name)
    totals = stories.agg(F.sum("n").cast("double").alias("articles"), F.count("*").cast("double").alias("stories"), count("several", F.col("n") > 1), count("papers", (F.col("n") > 1) & (F.col("papers") >= 2)), count("suspects", F.coalesce(F.col("max_d") > F.greatest("thr", F.lit(least)), F.lit(False))))
    total = totals.unpivot([], totals.columns, "key", "value").withColumn("part", F.lit("total"))
    split = X.compare_labels(old, new).select(F.lit("split").alias("part"), F.col("old").alias("key"), F.col("parts").cast("double").alias("value"))
    histogram = scores.groupBy(F.floor("significance_score").cast("string").alias("key")).agg(F.count("*").cast("double").alias("value")).withColumn("part", F.lit("score"))
    tier = scores.agg(F.count_if(F.col("significance_score") >= high).cast("double").alias("value")).select(F.lit("total").alias("part"), F.lit("high").alias("key"), "value")
    return reduce(DataFrame.unionByName, (split, total, histogram, tier))


@q("I10_recluster_recent")
def _(x):
    return recluster_recent(x.articles(), x.vectors(), F.lit("2024-01-03").cast("timestamp"), 48)


def recluster_recent(articles: DataFrame, vectors: DataFrame, now, hours: int) -> DataFrame:
    """part, key, text, value: every article's story after those of the last hours were taken out of theirs and, with all
    that have none, assigned anew (they may join any story that is left), the stories emptied by that, and the touched
    survivors' new scores."""
    inside = F.col("published_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))
    left = articles.withColumn("cluster_id", F.when(~inside, F.col("cluster_id")))
    touched = articles.where(inside & F.col("cluster_id").isNotNull()).select("cluster_id").distinct()
    remaining = left.where("cluster_id is not null").select("cluster_id").distinct()
    emptied = touched.join(remaining, "cluster_id", "left_anti")
    scores = cluster_score(left.join(touched, "cluster_id", "left_semi"))
    story = vectors.select("id", "published_at", "source_name", "vector", F.when(~inside, F.col("cluster_id")).alias("story"))
    again, kept = X.assign_stories(story, threshold(), hours=WINDOW_HOURS), story.where("story is not null")
    part = lambda df, name, key, text, value: df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), text.cast("string").alias("text"), value.cast("double").alias("value"))
    none = F.lit(None)
    members = part(kept, "kept", F.col("id"), F.col("story"), none).unionByName(part(again, "assigned", F.col("id"), F.col("story"), none))
    return members.unionByName(part(emptied, "dropped", F.col("cluster_id"), none, none)).unionByName(part(scores, "rescored", F.col("cluster_id"), none, F.col("significance_score")))


@q("M22_cluster_eval")
def _(x):
    return cluster_eval(x, days=31, loose=1.0)  # the test data has no stories in the last two weeks


def cluster_eval(x: Fixtures, days: int = 14, loose: float = NEWS, threshold: float = NEWS, hours: int = WINDOW_HOURS, sheet: int = 100) -> DataFrame:
    """part, key, value, text for the stories of the last days and their articles: totals, score and
    impact histograms, tier rates, false-merge and missed-merge suspects, and a sheet to label.

    The sheet takes the newest stories of several articles, then single ones in the order of a hash.
    """
    c = cut(recent(story_table(x.articles()), "first_published_at", as_of(), days).select("id", "headline", "significance_score", "first_published_at", "article_count"))
    ids = c.select(F.col("id").alias("cluster_id"))
    a = x.articles().join(ids, "cluster_id", "left_semi").select("id", "cluster_id", "title", "impact")
    v = x.vectors().join(ids, "cluster_id", "left_semi")

    def part(df, name, key, value, text=None):
        return df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), value.cast("double").alias("value"), (F.lit(None) if text is None else text).cast("string").alias("text"))

    score, n = F.col("significance_score"), F.col("n")
    scores = c.groupBy(F.floor(score).alias("s")).agg(F.count("*").alias("n"))
    impacts = a.groupBy(F.coalesce(F.col("impact").cast("string"), F.lit("none")).alias("s")).agg(F.count("*").alias("n"))
    rates = c.agg(F.avg((score >= TIER_HIGH).cast("double")).alias("high"), F.avg(((score >= TIER_NOTABLE) & (score < TIER_HIGH)).cast("double")).alias("notable"), F.count("*").alias("stories"))
    fives = a.agg(F.count("*").alias("articles"), F.coalesce(F.avg(F.coalesce(F.col("impact") == 5, F.lit(False)).cast("double")), F.lit(0.0)).alias("five"))
    false = X.intra_max(v).where(F.col("max_d") > loose).join(c, F.col("cluster_id") == c["id"])
    missed = X.missed_merges(v, threshold=threshold, hours=hours)
    titles = a.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("id", "title"))).alias("t"))
    single = F.col("article_count") <= 1
    labels = top_k(c, sheet, single, F.when(~single, -F.unix_micros("first_published_at")), F.xxhash64("id"), F.col("id")).join(titles, F.col("id") == titles["cluster_id"])
    line = F.concat_ws(" || ", "headline", F.transform("t", lambda e: e["title"]))
    parts = [
        part(rates, "total", F.lit("stories"), F.col("stories")), part(fives, "total", F.lit("articles"), F.col("articles")),
        part(scores, "score", F.col("s"), n), part(impacts, "impact", F.col("s"), n), part(fives, "impact rate", F.lit("5"), F.col("five")),
        part(rates, "tier", F.lit("high"), F.col("high")), part(rates, "tier", F.lit("notable"), F.col("notable")),
        part(false, "false merge", F.col("cluster_id"), F.col("max_d"), F.col("headline")),
        part(missed, "missed merge", F.concat_ws("|", "a", "b"), F.col("d")),
        part(labels, "label", F.col("id"), F.col("significance_score"), line),
    ]
    return reduce(DataFrame.unionByName, parts)


@q("M23_run_cycle")
def _(x):
    return run_cycle(x)


def run_cycle(x: Fixtures, most: int = 250) -> DataFrame:
    """part, key, value of one refresh, in its order: landed feed files are scanned, deduplicated, compared with the store
    and capped; new articles join stories, which merge (judged pairs too) and are scored; then the registry:
    roster, benchmarks, prices with debounce, coverage links; at last the record of the run.

    Ratings, vectors and verdicts enter as tables. A story's row has its score, an event's row the new value.
    """
    from lodestory.operators import prices as P
    from lodestory.operators import registry as R
    from lodestory.operators.stories import first_per_key
    from lodestory.plans.news import cap_newest, fresh_only
    from lodestory.plans.registry import steps
    from lodestory.plans.scans import land_feed
    from lodestory.sources import sinks

    ship(x.spark)
    feed = land_feed(x, x.articles().where("id % 4 = 0").select("id", "title", "source_url", "body_excerpt", "published_at"))
    a = cut(x.articles().drop("body_excerpt", "category", "lang", "ai_filter"))  # texts are in the feed
    stored, landed = a.where("id % 4 <> 0"), a.where("id % 4 = 0")
    feed = first_per_key(feed.withColumn("_t", F.lower("title")), ["source_url"], "published_at", "_t")
    feed = feed.join(first_per_key(landed, ["source_url"], "id").select("source_url", "id", "source_name"), "source_url")
    feed = first_per_key(feed, ["source_name", "_t"], "id").select("id")
    new, deferred = cap_newest(cut(fresh_only(landed.join(feed, "id", "left_semi"), stored, as_of())), most)
    new = cut(new)
    live = cut(stored.unionByName(new))
    story = F.when(F.col("id") % 4 != 0, F.col("cluster_id"))  # new articles have none yet
    vectors = cut(live.select("id", "published_at", "source_name", story.alias("story")).join(x.vectors().select("id", "vector"), "id"))
    assigned = cut(X.assign_stories(vectors, threshold(), hours=WINDOW_HOURS))
    known = assigned.unionByName(vectors.where("story is not null").select("id", "story"))
    placed = cut(vectors.drop("story").join(known, "id").withColumnRenamed("story", "cluster_id"))
    p = cut(X.story_points(placed, PAPER_PREFIX))
    band = X.ambiguous_pairs(p, low=NEWS, high=BAND, hours=WINDOW_HOURS)
    verdicts = band.select("a", "b", ((F.length("a") + F.length("b")) % 2 == 0).alias("same"))
    merged = X.merge_with_verdicts(p, X.close_pairs(p, news=NEWS, paper=PAPER, hours=WINDOW_HOURS), band, verdicts)
    final = placed.join(merged, placed["cluster_id"] == merged["old"]).select("id", F.col("new").alias("cluster_id"))
    scores = cut(cluster_score(live.drop("cluster_id").join(final, "id")))

    m = x.models()
    roster = sinks.upsert_adopt(m.where("id % 3 <> 0").select("id", "slug", F.when(F.col("id") % 2 == 0, F.concat(F.lit("k"), "id")).alias("epoch_key")), m.select(F.concat(F.lit("k"), "id").alias("epoch_key"), "slug"))
    b, samples = cut(x.benchmarks()), cut(x.price_samples())
    best = sinks.upsert_by_precedence(b.where("source = 'secondary'").select("model_id", "benchmark", "score", "source"), R.best_variant(b).withColumn("source", F.lit("primary")), ["model_id", "benchmark"], "score", primary="primary")
    moves = P.change_events(steps(samples), {"v": "price", "f": "price"})
    prices = P.vendor_and_floor(x.offers())
    confirmed = P.debounced_changes(samples)
    titles = new.join(final, "id", "left_semi").select("id", "title")
    links = R.match_models(titles, x.aliases(), "id", "title")

    part = lambda df, name, key, value: df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    count = lambda df, name, key: part(df.agg(F.count("*").alias("n")), name, F.lit(key), F.col("n"))
    outcomes = roster.groupBy("outcome").agg(F.count("*").alias("n"))
    parts = [
        part(scores, "story", F.col("cluster_id"), F.col("significance_score")), part(outcomes, "roster", F.col("outcome"), F.col("n")),
        count(best, "registry", "benchmarks"), count(prices, "registry", "priced"), count(moves, "registry", "price moves"),
        part(confirmed, "price event", F.concat_ws("|", "model_id", F.col("sample_ts").cast("date").cast("string"), "price_scope", "direction"), F.col("new_value")),
        part(links, "link", F.concat_ws("|", "id", "model_id"), F.lit(1)),
        count(new, "run", "articles ingested"), part(deferred, "run", F.lit("deferred"), F.col("deferred")), count(final.join(assigned.select("id"), "id", "left_semi").select("cluster_id").distinct(), "run", "clusters updated"),
    ]
    return reduce(DataFrame.unionByName, parts)
