"""Queries over models, benchmarks, offers and change events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lodestory.functions import scalars as S
from lodestory.functions import vocabulary as V
from lodestory.operators import prices as P
from lodestory.operators import registry as R
from lodestory.operators.stories import first_per_key, recent, top_k
from lodestory.plans.catalog import query
from lodestory.sources import sinks
from lodestory.sources.feeds import change_items, read_feed, write_feed
from lodestory.sources.fixtures import Fixtures, as_of
from lodestory.storage import cut, scratch

OWN = {
    "last_year": "SELECT * FROM models WHERE released_at >= DATE '2024-01-31' - 365",
    "year_scores": "SELECT b.* FROM model_benchmarks b JOIN last_year m ON m.id = b.model_id",
    "pct": "SELECT model_id, benchmark, score, CASE WHEN count(*) OVER (PARTITION BY benchmark) = 1 THEN 100 ELSE CAST(floor(percent_rank() OVER (PARTITION BY benchmark ORDER BY score) * 100 + 0.5) AS BIGINT) END AS pct FROM year_scores",
    "bucket_scores": "SELECT model_id, bucket, CAST(floor(avg(pct) + 0.5) AS BIGINT) AS score FROM pct JOIN bucket_map USING (benchmark) GROUP BY ALL",
    "overall": "SELECT model_id, CAST(floor(avg(score) + 0.5) AS BIGINT) AS overall FROM bucket_scores GROUP BY 1",
    "eci": "SELECT model_id, score AS eci FROM model_benchmarks WHERE benchmark = 'bench1'",
    "coverage": "SELECT model_id, count(*) AS n FROM model_clusters GROUP BY 1",
    "bench_count": "SELECT model_id, count(*) AS n_bench FROM model_benchmarks GROUP BY 1",
    "kept": "SELECT *, price_in / CASE WHEN discount > 0 AND discount < 1 THEN 1 - discount ELSE 1.0 END AS list_in, price_out / CASE WHEN discount > 0 AND discount < 1 THEN 1 - discount ELSE 1.0 END AS list_out FROM offers WHERE NOT regexp_matches(tag, '/(flex|priority|batch|off-?peak|turbo|high-?speed|fast)$', 'i')",
    "credible": "SELECT * EXCLUDE (native) FROM (SELECT *, max(context) FILTER (WHERE context > 0) OVER (PARTITION BY model_id) AS native FROM kept) WHERE status >= 0 AND discount = 0 AND NOT coalesce(regexp_matches(quant, '^(fp|int)[1-7]$', 'i'), false) AND NOT coalesce(context > 0 AND context < native * 0.5, false)",
    "own_offers": "SELECT * FROM (SELECT *, regexp_replace(lower(provider), '[^a-z0-9]', '', 'g') AS p, regexp_replace(lower(author), '[^a-z0-9]', '', 'g') AS a FROM kept) WHERE length(p) >= 3 AND length(a) >= 3 AND (starts_with(p, a) OR starts_with(a, p))",
    "modal": "SELECT model_id, list_in AS vendor_price_in, mx AS vendor_price_out FROM (SELECT model_id, list_in, count(*) AS n, max(list_out) AS mx FROM own_offers GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY n DESC, list_in DESC) = 1",
    "floors": "SELECT model_id, price_in AS floor_price_in, price_out AS floor_price_out, provider AS floor_provider, quant AS floor_quant, context AS floor_context FROM credible QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY price_in, price_out, ordinal) = 1",
    "prices": "SELECT coalesce(m.model_id, f.model_id) AS model_id, vendor_price_in, vendor_price_out, floor_price_in, floor_price_out, floor_provider, floor_quant, floor_context FROM modal m FULL JOIN floors f ON m.model_id = f.model_id",
    "cands": "SELECT m.id, m.slug, m.vendor, e.eci, coalesce(c.n, 0) AS news FROM last_year m JOIN eci e ON e.model_id = m.id JOIN bench_count b ON b.model_id = m.id AND n_bench >= 5 LEFT JOIN coverage c ON c.model_id = m.id",
    "vend": "SELECT *, CASE WHEN contains(lower(vendor), 'google') OR contains(lower(vendor), 'deepmind') THEN 'google' ELSE regexp_extract(lower(vendor), '^[^\\s(]*') END AS v FROM cands",
    "flags": "SELECT * FROM (SELECT * FROM vend QUALIFY row_number() OVER (PARTITION BY v ORDER BY eci DESC, id) = 1) ORDER BY eci DESC, id LIMIT 8",
    "wide": "SELECT m.*, e.eci, coalesce(c.n, 0) AS coverage, b1.score AS coding, b2.score AS math, b3.score AS reasoning, b4.score AS agentic FROM last_year m LEFT JOIN eci e ON e.model_id = m.id LEFT JOIN coverage c ON c.model_id = m.id LEFT JOIN bucket_scores b1 ON b1.model_id = m.id AND b1.bucket = 'coding' LEFT JOIN bucket_scores b2 ON b2.model_id = m.id AND b2.bucket = 'math' LEFT JOIN bucket_scores b3 ON b3.model_id = m.id AND b3.bucket = 'reasoning' LEFT JOIN bucket_scores b4 ON b4.model_id = m.id AND b4.bucket = 'agentic'",
}


def q(name: str, sql: str | None = None, **more: str):
    return query(name, sql, **OWN, **more)


def year(x: Fixtures) -> DataFrame:
    return R.last_year(x.models(), as_of())


def page(x: Fixtures, limit: int = 200) -> DataFrame:
    """The newest of last year's models, which a registry page shows and ranks among themselves."""
    return cut(top_k(year(x), limit, F.col("released_at").desc(), F.col("id")))


def year_scores(x: Fixtures, models: DataFrame | None = None) -> DataFrame:
    """Scores of the models of a population: all of last year's, if none is given."""
    models = year(x) if models is None else models
    return x.benchmarks().join(models.select(F.col("id").alias("model_id")), "model_id", "left_semi")


def buckets(x: Fixtures, models: DataFrame | None = None) -> DataFrame:
    return R.bucket_scores(R.percentiles(year_scores(x, models)), x.bucket_map())


def eci(x: Fixtures) -> DataFrame:
    return x.benchmarks().where("benchmark = 'bench1'").select("model_id", F.col("score").alias("eci"))


def coverage(x: Fixtures) -> DataFrame:
    return x.model_clusters().groupBy("model_id").agg(F.count("*").alias("n"))


def wide(x: Fixtures, models: DataFrame | None = None) -> DataFrame:
    """The models of a population (all of last year's, if none is given) with index, coverage and one column
    per bucket; percentiles are taken within the population."""
    b = buckets(x, models).groupBy("model_id").pivot("bucket", ["coding", "math", "reasoning", "agentic"]).agg(F.max("score"))
    m = (year(x) if models is None else models).withColumn("model_id", F.col("id"))
    return m.join(eci(x), "model_id", "left").join(coverage(x).withColumnRenamed("n", "coverage"), "model_id", "left").join(b, "model_id", "left").na.fill(0, ["coverage"]).drop("model_id")


def cands(x: Fixtures) -> DataFrame:
    n = x.benchmarks().groupBy("model_id").agg(F.count("*").alias("n_bench")).where("n_bench >= 5")
    m = year(x).select(F.col("id").alias("model_id"), "id", "slug", "vendor")
    return m.join(eci(x), "model_id").join(n, "model_id").join(coverage(x).withColumnRenamed("n", "news"), "model_id", "left").na.fill(0, ["news"]).select("id", "slug", "vendor", "eci", "news")


def joined_prices(x: Fixtures) -> DataFrame:
    return P.vendor_and_floor(x.offers())


@q("A11_sink_upsert_coalesce", "SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(n.family, o.family) AS family FROM (SELECT id, name, family FROM models WHERE id % 3 <> 0) o FULL JOIN (SELECT id, upper(name) AS name, CASE WHEN id % 4 = 0 THEN family || '!' END AS family FROM models WHERE id % 2 = 0 OR id % 3 = 0) n ON o.id = n.id")
def _(x):
    m = x.models().select("id", "name", "family")
    new = m.where("id % 2 = 0 or id % 3 = 0").select("id", F.upper("name").alias("name"), F.when(F.col("id") % 4 == 0, F.concat("family", F.lit("!"))).alias("family"))
    return sinks.upsert(m.where("id % 3 <> 0"), new, "id", overwrite=["name"], keep=["family"])


ADOPT = {"old_rows": "SELECT id, slug, CASE WHEN id % 2 = 0 THEN 'k' || id END AS epoch_key FROM models WHERE id % 3 <> 0", "new_rows": "SELECT CASE WHEN id % 5 = 0 THEN 'z' || id ELSE 'k' || id END AS epoch_key, slug FROM models WHERE id % 4 <> 3 OR id % 3 = 0"}


@q("A12_sink_upsert_adopt", "SELECT n.epoch_key, n.slug, CASE WHEN k.id IS NOT NULL THEN 'matched' WHEN s.id IS NULL THEN 'inserted' WHEN s.epoch_key IS NULL THEN 'adopted' ELSE 'collided' END AS outcome, coalesce(k.id, CASE WHEN s.epoch_key IS NULL THEN s.id END) AS id FROM new_rows n LEFT JOIN old_rows k ON k.epoch_key = n.epoch_key LEFT JOIN old_rows s ON s.slug = n.slug", **ADOPT)
def _(x):
    m = x.models().select("id", "slug")
    key = F.concat(F.lit("k"), "id")
    old = m.where("id % 3 <> 0").withColumn("epoch_key", F.when(F.col("id") % 2 == 0, key))
    new = m.where("id % 4 <> 3 or id % 3 = 0").select(F.when(F.col("id") % 5 == 0, F.concat(F.lit("z"), "id")).otherwise(key).alias("epoch_key"), "slug")
    return sinks.upsert_adopt(old, new)


@q("A13_sink_upsert_precedence", """SELECT coalesce(o.model_id, n.model_id) AS model_id, coalesce(o.benchmark, n.benchmark) AS benchmark, CASE WHEN w THEN n.score ELSE o.score END AS score, CASE WHEN w THEN n.source ELSE o.source END AS source FROM
    (SELECT o.*, n.*, n.source_1 IS NOT NULL AND (o.source IS NULL OR o.source <> 'primary' OR n.source_1 = 'primary') AS w FROM (SELECT * FROM model_benchmarks WHERE model_id % 2 = 0 OR model_id % 5 >= 3) o FULL JOIN (SELECT model_id AS m1, benchmark AS b1, score + 1 AS s1, CASE WHEN model_id % 3 = 0 THEN 'primary' ELSE 'secondary' END AS source_1 FROM model_benchmarks WHERE model_id % 5 < 3) n ON o.model_id = m1 AND o.benchmark = b1) z,
    LATERAL (SELECT z.model_id, z.benchmark, z.score, z.source) o, LATERAL (SELECT z.m1 AS model_id, z.b1 AS benchmark, z.s1 AS score, z.source_1 AS source) n""")
def _(x):
    b = x.benchmarks().select("model_id", "benchmark", "score", "source")
    new = b.where("model_id % 5 < 3").select("model_id", "benchmark", (F.col("score") + 1).alias("score"), F.when(F.col("model_id") % 3 == 0, "primary").otherwise("secondary").alias("source"))
    return sinks.upsert_by_precedence(b.where("model_id % 2 = 0 or model_id % 5 >= 3"), new, ["model_id", "benchmark"], "score", primary="primary")


@q("A14_sink_gated_append", "SELECT user_id, event_id FROM events n WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-05 06:00:00' AND NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = n.user_id AND o.ts < TIMESTAMP '2024-01-05' AND o.ts > TIMESTAMP '2024-01-04 04:00:00')")
def _(x):
    e, now = x.events(), F.lit("2024-01-05").cast("timestamp")
    new = e.where((F.col("ts") >= now) & (F.col("ts") < now + F.expr("INTERVAL 6 HOURS")))
    return sinks.gated_append(e.where(F.col("ts") < now), new, "user_id", "ts", now).select("user_id", "event_id")


@q("A15_sink_link_ignore_max", "SELECT m.id, greatest(m.significance, (SELECT max(c.significance_score) FROM model_clusters k JOIN clusters c ON c.id = k.cluster_id WHERE k.model_id = m.id AND k.model_id % 2 = 0)) AS significance FROM models m")
def _(x):
    links = x.model_clusters()
    stories = x.clusters().select(F.col("id").alias("cluster_id"), "significance_score")
    _, risen = sinks.link_ignore_max(x.models(), links.where("model_id % 2 <> 0"), links.join(stories, "cluster_id"))
    return risen.select("id", F.col("significance").cast("double").alias("significance"))


@q("A23_export_change_feed", "SELECT CAST(e.id AS VARCHAR) AS id, CASE WHEN event_type = 'price' THEN 'price:' || price_scope ELSE event_type END AS category, m.name || ': ' || event_type AS title, 'https://news.example/models/' || m.slug AS link, CAST(detected_at AS DATE) AS day FROM model_events e JOIN models m ON m.id = e.model_id WHERE detected_at >= AS_OF - INTERVAL 30 DAY AND NOT (event_type = 'price' AND price_scope IS NULL)")
def _(x):
    """The feed is written as JSON, a folder per day, and read again."""
    e = legacy_free(recent(x.model_events(), "detected_at", as_of(), 30))
    m = x.models().select(F.col("id").alias("model_id"), F.col("slug").alias("model_slug"), "name")
    told = e.join(m, "model_id").withColumn("summary", F.concat("name", F.lit(": "), "event_type"))
    path = write_feed(change_items(told, site="https://news.example"), scratch(x.spark), "json")
    return read_feed(x.spark, path, "json").select(F.col("guid._VALUE").alias("id"), "category", "title", "link", "day")


def legacy_free(events: DataFrame) -> DataFrame:
    """Without price events of no scope."""
    return events.where(~((F.col("event_type") == "price") & F.col("price_scope").isNull()))


@q("B8_filter_legacy_events", "SELECT id FROM model_events WHERE NOT (event_type = 'price' AND price_scope IS NULL)")
def _(x):
    return legacy_free(x.model_events()).select("id")


@q("B11_filter_leaderboard", "SELECT id FROM models WHERE contains(lower(name || ' ' || vendor), 'ring') AND is_open_weight IS TRUE")
def _(x):
    return leaderboard(x.models(), "ring", True).select("id")


def leaderboard(models: DataFrame, text: str, is_open: bool | None) -> DataFrame:
    hit = F.lower(F.concat_ws(" ", "name", "vendor")).contains(text.lower())
    return models.where(hit if is_open is None else hit & F.col("is_open_weight").eqNullSafe(F.lit(is_open)))


@q("B13_filter_new_release", "SELECT id, slug FROM (SELECT id, slug, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k, vendor, name FROM models WHERE released_at >= DATE '2024-01-31' - 60) WHERE lower(vendor) <> 'brand#11' AND NOT contains(lower(name), 'blue') AND k NOT IN (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') FROM models WHERE id <= 20) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY id) = 1")
def _(x):
    m = x.models().withColumn("k", S.normalize_key(F.col("name")))
    return new_releases(R.last_year(m, as_of(), 60), m.where("id <= 20").select("k"), router="Brand#11", skip=["blue"]).select("id", "slug")


def new_releases(rows: DataFrame, known: DataFrame, *, router: str, skip: list[str]) -> DataFrame:
    """Rows of no known key, not the router's own, without serving words, the first of each slug."""
    fine = rows.where((F.lower("vendor") != router.lower()) & ~S.contains_any(F.lower("name"), skip) & (F.col("name") != ""))
    return first_per_key(fine.join(known, "k", "left_anti"), ["slug"], "id")


@q("B16_filter_credible_offers", "SELECT model_id, ordinal FROM credible")
def _(x):
    return P.credible_offers(P.kept_offers(x.offers())).select("model_id", "ordinal")


@q("B17_filter_material_move", "SELECT id FROM model_events WHERE NOT (event_type = 'price' AND price_scope IS NOT DISTINCT FROM 'floor') OR coalesce(old_num > 0 AND abs((new_num - old_num) / old_num * 100) >= 15, false)")
def _(x):
    e = x.model_events()
    return e.where(S.is_material(F.col("event_type"), F.col("price_scope"), F.col("old_num").cast("string"), F.col("new_num").cast("string"))).select("id")


@q("C10_join_alias_dict", "SELECT DISTINCT a.id, k.model_id FROM articles a JOIN aliases k ON regexp_matches(lower(a.title || ' ' || a.body_excerpt), '(^|[^a-z0-9])' || regexp_escape(k.alias) || '($|[^a-z0-9.\\-])') OR contains(regexp_replace(lower(a.title || ' ' || a.body_excerpt), '[^a-z0-9]', '', 'g'), regexp_replace(k.alias, '[^a-z0-9]', '', 'g')) AND length(regexp_replace(k.alias, '[^a-z0-9]', '', 'g')) >= 5 AND regexp_matches(regexp_replace(lower(a.title || ' ' || a.body_excerpt), '[^a-z0-9]', '', 'g'), regexp_replace(k.alias, '[^a-z0-9]', '', 'g') || '($|[^0-9])')")
def _(x):
    a = x.articles().select("id", F.concat("title", F.lit(" "), "body_excerpt").alias("text"))
    return R.match_models(a, x.aliases(), "id", "text")


@q("C11_join_normalised_key", "SELECT b.model_id AS id, m.id AS target FROM (SELECT id AS model_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM models) b JOIN (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k, min(id) AS id FROM models GROUP BY 1) m ON m.k = CASE WHEN contains(b.k, 'blue') THEN replace(b.k, 'blue', 'red') ELSE b.k END")
def _(x):
    m = x.models().withColumn("k", S.normalize_key(F.col("name")))
    alias = m.where(F.col("k").contains("blue")).select("k", F.replace("k", F.lit("blue"), F.lit("red")).alias("to")).distinct()
    registry = m.groupBy("k").agg(F.min("id").alias("target"))
    rows = m.select("id", "k").join(alias, "k", "left").select("id", F.coalesce("to", "k").alias("k"))  # aliases are a hand-kept list
    return rows.join(registry, "k").select("id", "target")


@q("C13_join_offer_vendor", "SELECT model_id, ordinal FROM own_offers")
def _(x):
    return P.own_offers(P.kept_offers(x.offers())).select("model_id", "ordinal")


@q("C15_cross_flagships", "SELECT a.slug AS a, b.slug AS b FROM flags a JOIN flags b ON a.slug < b.slug")
def _(x):
    return R.unordered_pairs(R.flagships(cands(x)), "slug")


@q("C16_join_coverage_threshold", "SELECT m.id, c.n FROM models m JOIN coverage c ON c.model_id = m.id AND c.n >= 3")
def _(x):
    c = coverage(x).where("n >= 3")
    return x.models().join(c, F.col("id") == c["model_id"]).select("id", "n")


@q("C17_scalar_subquery_project", "SELECT m.id, (SELECT eci FROM eci e WHERE e.model_id = m.id) AS eci, (SELECT count(*) FROM model_clusters c WHERE c.model_id = m.id) AS news FROM models m")
def _(x):
    m = x.models().select(F.col("id").alias("model_id"))
    return m.join(eci(x), "model_id", "left").join(coverage(x), "model_id", "left").select(F.col("model_id").alias("id"), "eci", F.coalesce("n", F.lit(0)).alias("news"))


@q("C19_sequence_asof", "SELECT model_id, sample_ts, vendor_in, lag(vendor_in) OVER (PARTITION BY model_id ORDER BY sample_ts) AS stored FROM price_samples")
def _(x):
    return x.price_samples().select("model_id", "sample_ts", "vendor_in", F.lag("vendor_in").over(Window.partitionBy("model_id").orderBy("sample_ts")).alias("stored"))


@q("D13_agg_best_variant_max", "SELECT l_partkey AS model_id, 'bench' || l_linenumber AS benchmark, max(l_quantity / 50) AS score FROM lineitem GROUP BY ALL")
def _(x):
    l = x.table("lineitem")
    return R.best_variant(l.select(F.col("l_partkey").alias("model_id"), F.concat(F.lit("bench"), "l_linenumber").alias("benchmark"), (F.col("l_quantity") / 50).alias("score")))


VARIANTS = "SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k, id, CASE WHEN id % 7 <> 0 THEN price_in END AS idx, CASE WHEN id % 3 <> 0 THEN context_window END AS speed, CASE WHEN id % 5 <> 0 THEN price_out END AS ttft FROM models"


def variants(x: Fixtures) -> DataFrame:
    m = x.models()
    return m.select(S.normalize_key(F.col("name")).alias("k"), "id", F.when(F.col("id") % 7 != 0, F.col("price_in")).alias("idx"), F.when(F.col("id") % 3 != 0, F.col("context_window")).alias("speed"), F.when(F.col("id") % 5 != 0, F.col("price_out")).alias("ttft"))


@q("D14_agg_strongest_variant", "SELECT k, id FROM variants QUALIFY row_number() OVER (PARTITION BY k ORDER BY coalesce(idx, -1) DESC, id) = 1", variants=VARIANTS)
def _(x):
    return R.strongest_variant(variants(x), "k", "idx", "id").select("k", "id")


@q("D15_agg_strongest_speed", "SELECT k, id, speed, ttft FROM (SELECT * FROM variants QUALIFY row_number() OVER (PARTITION BY k ORDER BY coalesce(idx, -1) DESC, id) = 1) WHERE speed IS NOT NULL OR ttft IS NOT NULL", variants=VARIANTS)
def _(x):
    return R.strongest_with(variants(x), "k", "idx", "id", ["speed", "ttft"]).select("k", "id", "speed", "ttft")


@q("D16_agg_cheapest_variant", "SELECT k, id, CASE WHEN idx > 0 THEN idx END AS idx FROM variants QUALIFY row_number() OVER (PARTITION BY k ORDER BY idx IS NULL OR idx <= 0, idx, id) = 1", variants=VARIANTS)
def _(x):
    return R.cheapest_variant(variants(x), "k", "idx", "id").select("k", "id", "idx")


@q("D17_agg_modal_list_price", "SELECT model_id, vendor_price_in, vendor_price_out FROM modal")
def _(x):
    return P.modal_list_price(P.own_offers(P.kept_offers(x.offers())))


@q("D18_agg_floor_offer", "SELECT * FROM floors")
def _(x):
    return P.floor_offer(P.credible_offers(P.kept_offers(x.offers())))


@q("D21_agg_link_counts", "SELECT * FROM coverage")
def _(x):
    return coverage(x)


@q("D26_agg_vendor_flagship", "SELECT slug, v, eci FROM flags")
def _(x):
    return R.flagships(cands(x)).select("slug", "v", "eci")


BURST = "SELECT m.vendor, count(*) AS n FROM model_events e JOIN models m ON m.id = e.model_id WHERE e.event_type = 'catalog' GROUP BY 1"


@q("D27_agg_catalog_burst", f"{BURST} ORDER BY n DESC, vendor LIMIT 1")
def _(x):
    e, m = x.model_events().where("event_type = 'catalog'"), x.models()
    return top_k(e.join(m, e["model_id"] == m["id"]).groupBy("vendor").agg(F.count("*").alias("n")), 1, F.col("n").desc(), F.col("vendor"))


@q("D28_agg_best_in_row", "SELECT attribute, id AS winner FROM (SELECT 'price_in' AS attribute, id, -price_in AS v FROM models WHERE id <= 4 UNION ALL SELECT 'context_window', id, context_window FROM models WHERE id <= 4 UNION ALL SELECT 'eci', m.id, e.eci FROM models m JOIN eci e ON e.model_id = m.id WHERE m.id <= 4) QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY v DESC, id) = 1 AND count(*) OVER (PARTITION BY attribute) >= 2")
def _(x):
    m = x.models().where("id <= 4").withColumnRenamed("id", "model_id").join(eci(x), "model_id", "left").withColumnRenamed("model_id", "id")
    return R.best_in_row(m, {"price_in": False, "context_window": True, "eci": True})


@q("E2_win_percentile_rank", "SELECT model_id, benchmark, pct FROM pct")
def _(x):
    return R.percentiles(year_scores(x)).select("model_id", "benchmark", "pct")


@q("E3_win_bucket_composite", "SELECT * FROM bucket_scores")
def _(x):
    return buckets(x)


@q("E4_win_overall_composite", "SELECT * FROM overall")
def _(x):
    return R.overall(buckets(x))


FRONT = "SELECT id, eci, price_in{0} FROM (SELECT w.*, max(eci) OVER ({1}ORDER BY price_in, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM wide w WHERE eci IS NOT NULL AND price_in IS NOT NULL) WHERE m IS NULL OR eci > m"


@q("E5_win_running_max_frontier", FRONT.format("", ""))
def _(x):
    return R.running_max_frontier(wide(x), "price_in", "eci", "id").select("id", "eci", "price_in")


@q("E6_win_group_frontier", FRONT.format(", is_open_weight", "PARTITION BY is_open_weight "))
def _(x):
    return R.running_max_frontier(wide(x), "price_in", "eci", "id", ["is_open_weight"]).select("id", "eci", "price_in", "is_open_weight")


@q("E8_win_slug_disambiguate", "SELECT id, slug FROM models")
def _(x):
    return x.models().select("id", "slug")


@q("E10_win_lag_change", "SELECT model_id, sample_ts, floor_in - lag(floor_in) OVER (PARTITION BY model_id ORDER BY sample_ts) AS change FROM price_samples")
def _(x):
    return x.price_samples().select("model_id", "sample_ts", (F.col("floor_in") - F.lag("floor_in").over(Window.partitionBy("model_id").orderBy("sample_ts"))).alias("change"))


@q("E11_win_vendor_recency_order", "SELECT e.id, m.vendor, max(e.detected_at) OVER (PARTITION BY m.vendor) AS latest FROM model_events e JOIN models m ON m.id = e.model_id")
def _(x):
    e, m = x.model_events(), x.models().select(F.col("id").alias("model_id"), "vendor")
    return by_vendor_recency(e.join(m, "model_id")).select("id", "vendor", "latest")


def by_vendor_recency(events: DataFrame) -> DataFrame:
    """Groups by their newest event; the maximum is aggregated first, so a busy vendor is no hot window."""
    return events.join(events.groupBy("vendor").agg(F.max("detected_at").alias("latest")), "vendor")


@q("F6_sort_null_edges", "SELECT id, eci FROM wide ORDER BY eci ASC NULLS LAST, id LIMIT 30")
def _(x):
    return top_k(wide(x), 30, F.col("eci").asc_nulls_last(), F.col("id")).select("id", "eci")


@q("F8_sort_index_first", "SELECT row_number() OVER (ORDER BY unit <> 'index', benchmark) AS pos, benchmark FROM (SELECT DISTINCT benchmark, unit FROM model_benchmarks WHERE model_id = 7)")
def _(x):
    b = x.benchmarks().where("model_id = 7").select("benchmark", "unit").distinct()
    return b.select(F.row_number().over(Window.orderBy(F.col("unit") != "index", "benchmark")).alias("pos"), "benchmark")


@q("F9_topk_oldest_synced", "SELECT m.id FROM models m LEFT JOIN (SELECT model_id, max(detected_at) AS synced FROM model_events GROUP BY 1) s ON s.model_id = m.id ORDER BY synced ASC NULLS FIRST, m.id LIMIT 12")
def _(x):
    s = x.model_events().groupBy(F.col("model_id").alias("id")).agg(F.max("detected_at").alias("synced"))
    return top_k(x.models().join(s, "id", "left"), 12, F.col("synced").asc_nulls_first(), F.col("id")).select("id")


RANK = "SELECT '{0}' AS view, id, round(value, 6) AS value FROM (SELECT id, {1} AS value FROM wide) WHERE value IS NOT NULL ORDER BY value DESC, id LIMIT 20"
RANKS = {"overall": "eci", "value": "eci / CASE WHEN (price_in + price_out) / 2 > 0 THEN (price_in + price_out) / 2 END", **{b: b for b in ("coding", "math", "reasoning", "agentic")}}


@q("F11_rank_models", " UNION ALL ".join(f"SELECT * FROM ({RANK.format(k, v)})" for k, v in RANKS.items()))
def _(x):
    w = cut(wide(x))
    return reduce(DataFrame.unionByName, [top_k(R.rank_models(w, view), 20, F.col("value").desc(), F.col("id")).select(F.lit(view).alias("view"), "id", F.round("value", 6).alias("value")) for view in RANKS])


@q("F12_cheapest_of_top10", "SELECT id, price_in FROM (SELECT id, price_in FROM wide WHERE coding IS NOT NULL ORDER BY coding DESC, id LIMIT 10) WHERE price_in IS NOT NULL ORDER BY price_in, id LIMIT 1")
def _(x):
    top = top_k(R.rank_models(wide(x), "coding"), 10, F.col("value").desc(), F.col("id")).where("price_in is not null")
    return top_k(top, 1, F.col("price_in"), F.col("id")).select("id", "price_in")


@q("F13_topk_discounts", "SELECT model_id, round((1 - floor_price_in / vendor_price_in) * 100, 4) AS pct FROM prices WHERE vendor_price_in > 0 AND (1 - floor_price_in / vendor_price_in) * 100 >= 5 ORDER BY pct DESC, model_id LIMIT 10")
def _(x):
    return discounts(x)


def discounts(x: Fixtures) -> DataFrame:
    """The ten largest discounts of the floor on the vendor's list price, of 5 % or more."""
    pct = S.discount_pct(F.col("floor_price_in"), F.col("vendor_price_in"))
    rows = joined_prices(x).withColumn("pct", pct).where("pct >= 5").select("model_id", F.round("pct", 4).alias("pct"))
    return top_k(rows, 10, F.col("pct").desc(), F.col("model_id"))


@q("G1_union_roster_precedence", "SELECT id, 'first' AS roster FROM models WHERE id % 2 = 0 UNION ALL SELECT id, 'second' FROM models WHERE id % 2 = 1 AND regexp_replace(lower(name), '[^a-z0-9]', '', 'g') NOT IN (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') FROM models WHERE id % 2 = 0 AND id < 60)")
def _(x):
    m = x.models().withColumn("k", S.normalize_key(F.col("name")))
    a, b = m.where("id % 2 = 0"), m.where("id % 2 = 1")
    rest = b.join(a.where("id < 60").select("k"), "k", "left_anti")
    return a.select("id", F.lit("first").alias("roster")).unionByName(rest.select("id", F.lit("second").alias("roster")))


PAIRS = "SELECT a.slug AS a, b.slug AS b FROM flags a JOIN flags b ON a.slug < b.slug UNION SELECT least(c.slug, f.slug), greatest(c.slug, f.slug) FROM vend c JOIN flags f ON f.v = c.v WHERE c.news >= 5 AND c.slug <> f.slug"


@q("G4_distinct_pairs", PAIRS)
def _(x):
    return R.compare_pairs(cands(x), 5)


CHANGED = "SELECT id FROM models WHERE released_at >= DATE '2024-01-31' - 3 UNION SELECT model_id FROM model_events WHERE detected_at >= TIMESTAMP '2024-01-05' - INTERVAL 4 HOUR AND detected_at < TIMESTAMP '2024-01-05'"


def changed_keys(x: Fixtures) -> DataFrame:
    now = F.lit("2024-01-05").cast("timestamp")
    moved = x.model_events().where((F.col("detected_at") >= now - F.expr("INTERVAL 4 HOURS")) & (F.col("detected_at") < now)).select(F.col("model_id").alias("id"))
    return R.last_year(x.models(), as_of(), 3).select("id").unionByName(moved).distinct()


@q("G7_distinct_changed_keys", CHANGED)
def _(x):
    return changed_keys(x)


@q("M24_changed_keys", CHANGED)
def _(x):
    return changed_keys(x)


SAMPLES = "SELECT model_id, sample_ts, vendor_in AS new_v, floor_in AS new_f, lag(vendor_in) OVER w AS old_v, lag(floor_in) OVER w AS old_f FROM price_samples WINDOW w AS (PARTITION BY model_id ORDER BY sample_ts)"


def sample_steps(x: Fixtures) -> DataFrame:
    return steps(x.price_samples())


def steps(samples: DataFrame) -> DataFrame:
    """Each sample's prices beside those of the model's sample before."""
    w = Window.partitionBy("model_id").orderBy("sample_ts")
    return samples.select("model_id", "sample_ts", F.col("vendor_in").alias("new_v"), F.col("floor_in").alias("new_f"), F.lag("vendor_in").over(w).alias("old_v"), F.lag("floor_in").over(w).alias("old_f"))


@q("J1_price_change_events", "SELECT model_id, 'price' AS event_type, 'v' AS field, old_v AS old, new_v AS new FROM steps WHERE old_v > 0 AND abs((new_v - old_v) / old_v) >= 0.05 UNION ALL SELECT model_id, 'price', 'f', old_f, new_f FROM steps WHERE old_f > 0 AND abs((new_f - old_f) / old_f) >= 0.05", steps=SAMPLES)
def _(x):
    return P.change_events(sample_steps(x), {"v": "price", "f": "price"})


@q("J2_benchmark_change_events", "SELECT a.model_id, 'benchmark' AS event_type, 'score' AS field, a.score AS old, b.score AS new FROM (SELECT * FROM model_benchmarks WHERE benchmark = 'bench2') a JOIN (SELECT * FROM model_benchmarks WHERE benchmark = 'bench4') b ON a.model_id = b.model_id AND a.source = b.source WHERE a.score > 0 AND abs((b.score - a.score) / a.score) >= 0.05")
def _(x):
    b = x.benchmarks()
    old = b.where("benchmark = 'bench2'").select("model_id", "source", F.col("score").alias("old_score"))
    new = b.where("benchmark = 'bench4'").select("model_id", "source", F.col("score").alias("new_score"))
    return P.change_events(old.join(new, ["model_id", "source"]), {"score": "benchmark"})


@q("J3_price_changed", "SELECT model_id, sample_ts, CASE WHEN old_v IS NULL AND new_v IS NULL THEN false WHEN old_v IS NULL OR new_v IS NULL THEN true ELSE abs(new_v - old_v) > 1e-9 END AS vendor_changed, CASE WHEN old_f IS NULL AND new_f IS NULL THEN false WHEN old_f IS NULL OR new_f IS NULL THEN true ELSE old_f > 0 AND abs((new_f - old_f) / old_f) >= 0.05 END AS floor_changed FROM steps", steps=SAMPLES)
def _(x):
    s = sample_steps(x)
    return s.select("model_id", "sample_ts", P.price_changed(F.col("old_v"), F.col("new_v"), exact=True).alias("vendor_changed"), P.price_changed(F.col("old_f"), F.col("new_f"), exact=False).alias("floor_changed"))


@q("J4_debounced_changes")
def _(x):
    from lodestory.shipping import ship

    ship(x.spark)
    return P.debounced_changes(x.price_samples())


@q("J4_confirmed_by_two", "SELECT model_id, sample_ts, p2 AS old_value, floor_in AS new_value FROM (SELECT *, lag(floor_in, 1) OVER w AS p1, lag(floor_in, 2) OVER w AS p2 FROM price_samples WHERE floor_in IS NOT NULL WINDOW w AS (PARTITION BY model_id ORDER BY sample_ts)) WHERE floor_in = p1 AND p1 <> p2")
def _(x):
    return P.confirmed_by_two(x.price_samples(), "floor_in")


@q("J5_first_attach", "SELECT m.id, s.vendor_in, coalesce(s.floor_in, m.price_in) AS price_in FROM models m JOIN (SELECT * FROM price_samples QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY sample_ts) = 1) s ON s.model_id = m.id")
def _(x):
    first = first_per_key(x.price_samples(), ["model_id"], "sample_ts")
    m = x.models()
    return m.join(first, m["id"] == first["model_id"]).select("id", "vendor_in", F.coalesce("floor_in", "price_in").alias("price_in"))


@q("J6_single_writer_guard", "SELECT m.id, CASE WHEN m.id IN (SELECT model_id FROM price_samples) THEN m.price_in ELSE m.price_in * 2 END AS price_in FROM models m")
def _(x):
    managed = x.price_samples().select(F.col("model_id").alias("id")).distinct().withColumn("managed", F.lit(True))
    return x.models().join(managed, "id", "left").select("id", F.when(F.col("managed"), F.col("price_in")).otherwise(F.col("price_in") * 2).alias("price_in"))


@q("J7_vendor_and_floor", "SELECT * FROM prices")
def _(x):
    return joined_prices(x)


@q("J8_catalog_added_events", "SELECT id AS model_id, name || ' added: ' || (context_window // 1000) || 'K context' AS summary FROM models WHERE released_at >= DATE '2024-01-31' - 90 AND id NOT IN (SELECT model_id FROM model_benchmarks WHERE benchmark = 'bench1')")
def _(x):
    known = x.benchmarks().where("benchmark = 'bench1'").select(F.col("model_id").alias("id"))
    added = R.last_year(x.models(), as_of(), 90).join(known, "id", "left_anti")
    return added.select(F.col("id").alias("model_id"), F.concat("name", F.lit(" added: "), F.floor(F.col("context_window") / 1000), F.lit("K context")).alias("summary"))


@q("J9_floor_fact", "SELECT p.model_id, round(floor_price_in / vendor_price_in, 6) AS ratio FROM prices p JOIN coverage c ON c.model_id = p.model_id AND c.n >= 3 WHERE vendor_price_in > 0 AND floor_price_in > 0 AND floor_price_in < vendor_price_in AND floor((1 - floor_price_in / vendor_price_in) * 100 + 0.5) >= 20 ORDER BY ratio, p.model_id LIMIT 1")
def _(x):
    return floor_fact(x)


def floor_fact(x: Fixtures) -> DataFrame:
    p = joined_prices(x).join(coverage(x).where("n >= 3"), "model_id").where("vendor_price_in > 0 and floor_price_in > 0 and floor_price_in < vendor_price_in")
    fine = p.where(S.half_up(S.discount_pct(F.col("floor_price_in"), F.col("vendor_price_in"))) >= 20)
    return top_k(fine.select("model_id", F.round(F.col("floor_price_in") / F.col("vendor_price_in"), 6).alias("ratio")), 1, F.col("ratio"), F.col("model_id"))


@q("J11_alias_index", "SELECT lower(trim(name)) AS alias, min(id) AS model_id FROM models WHERE length(trim(name)) >= 4 GROUP BY 1")
def _(x):
    return R.alias_index(x.models())


@q("M8_registry", "SELECT m.id, m.slug, m.eci, m.coverage, m.coding, m.math, m.reasoning, m.agentic FROM wide m")
def _(x):
    return wide(x).select("id", "slug", "eci", "coverage", "coding", "math", "reasoning", "agentic")


DETAIL = "SELECT id FROM models WHERE slug = (SELECT min(slug) FROM models)"


@q("M9_model_detail", """SELECT 'benchmark' AS part, b.benchmark AS key, b.score AS value, p.pct FROM model_benchmarks b JOIN one ON one.id = b.model_id LEFT JOIN (SELECT model_id, benchmark, CASE WHEN count(*) OVER (PARTITION BY benchmark) = 1 THEN 100 ELSE CAST(floor(percent_rank() OVER (PARTITION BY benchmark ORDER BY score) * 100 + 0.5) AS BIGINT) END AS pct FROM model_benchmarks WHERE model_id IN (SELECT id FROM last_year UNION SELECT id FROM one)) p ON p.model_id = b.model_id AND p.benchmark = b.benchmark
    UNION ALL SELECT * FROM (SELECT 'story', c.id, c.significance_score, CAST(NULL AS BIGINT) FROM clusters c JOIN model_clusters k ON k.cluster_id = c.id JOIN one ON one.id = k.model_id ORDER BY c.first_published_at DESC, c.id LIMIT 30)
    UNION ALL SELECT * FROM (SELECT 'event', CAST(e.id AS VARCHAR), e.new_num, CAST(NULL AS BIGINT) FROM model_events e JOIN one ON one.id = e.model_id WHERE NOT (event_type = 'price' AND price_scope IS NULL) ORDER BY e.detected_at DESC, e.id DESC LIMIT 40)""", one=DETAIL)
def _(x):
    m = x.models()
    one = top_k(m.select("slug", "id"), 1, F.col("slug")).select(F.col("id").alias("model_id"))
    population = year(x).select(F.col("id").alias("model_id")).unionByName(one).distinct()
    pct = R.percentiles(x.benchmarks().join(population, "model_id", "left_semi")).join(one, "model_id", "left_semi")
    c = x.clusters().join(x.model_clusters().join(one, "model_id", "left_semi").select(F.col("cluster_id").alias("id")), "id")
    stories = top_k(c, 30, F.col("first_published_at").desc(), F.col("id"))
    events = top_k(legacy_free(x.model_events()).join(one, "model_id", "left_semi"), 40, F.col("detected_at").desc(), F.col("id").desc())
    part = lambda df, name, key, value, p: df.select(F.lit(name).alias("part"), key.cast("string").alias("key"), value.cast("double").alias("value"), p.cast("long").alias("pct"))
    none = F.lit(None)
    return part(pct, "benchmark", F.col("benchmark"), F.col("score"), F.col("pct")).unionByName(part(stories, "story", F.col("id"), F.col("significance_score"), none)).unionByName(part(events, "event", F.col("id"), F.col("new_num"), none))


#: What a comparison of models looks at, and whether more is better.
MEASURES = {"price_in": False, "price_out": False, "context_window": True, "eci": True, "coding": True, "math": True, "reasoning": True, "agentic": True}


@q("M10_compare_models", "SELECT 'bucket' AS part, id, bucket AS key, CAST(score AS DOUBLE) AS value FROM bucket_scores JOIN asked ON id = model_id UNION ALL SELECT 'benchmark', id, benchmark, score FROM model_benchmarks JOIN asked ON id = model_id UNION ALL SELECT 'index', a.id, 'eci', eci FROM asked a LEFT JOIN eci ON a.id = model_id UNION ALL SELECT 'best', arg_max(id, (v, -id)), key, arg_max(v * up, (v, -id)) FROM (" + " UNION ALL ".join(f"SELECT w.id, '{k}' AS key, {1 if up else -1} AS up, {1 if up else -1} * CAST({k} AS DOUBLE) AS v FROM wide w JOIN asked ON asked.id = w.id" for k, up in MEASURES.items()) + ") WHERE v IS NOT NULL GROUP BY key HAVING count(*) >= 2", asked="SELECT id FROM last_year ORDER BY id LIMIT 4")
def _(x):
    asked = top_k(year(x), 4, F.col("id")).select("id")
    part = lambda df, name, ident, key, value: df.select(F.lit(name).alias("part"), F.col(ident).alias("id"), key.alias("key"), value.cast("double").alias("value"))
    of = lambda df: df.join(asked.withColumnRenamed("id", "model_id"), "model_id", "left_semi")
    w = wide(x).join(asked, "id", "left_semi")
    best = R.best_in_row(w, MEASURES)
    values = w.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), F.col(k).cast("double").alias("v")) for k in MEASURES])).alias("s")).select(F.col("id").alias("winner"), "s.*")
    rows = [
        part(of(buckets(x)), "bucket", "model_id", F.col("bucket"), F.col("score")), part(of(x.benchmarks()), "benchmark", "model_id", F.col("benchmark"), F.col("score")),
        part(w, "index", "id", F.lit("eci"), F.col("eci")), part(best.join(values, ["winner", "attribute"]), "best", "winner", F.col("attribute"), F.col("v")),
    ]
    return reduce(DataFrame.unionByName, rows)


@q("M11_best_models", " UNION ALL ".join(f"SELECT view, id FROM ({RANK.format(k, v)})" for k, v in RANKS.items()) + " UNION ALL SELECT 'cheapest', id FROM (SELECT id FROM (SELECT id, price_in FROM wide WHERE coding IS NOT NULL ORDER BY coding DESC, id LIMIT 10) ORDER BY price_in, id LIMIT 1)")
def _(x):
    w = cut(wide(x))
    views = [top_k(R.rank_models(w, view), 20, F.col("value").desc(), F.col("id")).select(F.lit(view).alias("view"), "id") for view in RANKS]
    cheap = top_k(top_k(R.rank_models(w, "coding"), 10, F.col("value").desc(), F.col("id")), 1, F.col("price_in"), F.col("id"))
    return reduce(DataFrame.unionByName, [*views, cheap.select(F.lit("cheapest").alias("view"), "id")])


@q("M12_change_feed", "SELECT e.id, m.vendor FROM (SELECT * FROM model_events WHERE detected_at >= AS_OF - INTERVAL 30 DAY AND NOT (event_type = 'price' AND price_scope IS NULL)) e JOIN models m ON m.id = e.model_id ORDER BY e.detected_at DESC, e.id DESC LIMIT 300")
def _(x):
    e, m = legacy_free(recent(x.model_events(), "detected_at", as_of(), 30)), x.models().select(F.col("id").alias("model_id"), "vendor")
    return top_k(e.join(m, "model_id"), 300, F.col("detected_at").desc(), F.col("id").desc()).select("id", "vendor")


@q("M13_digest_teaser")
def _(x):
    return digest_teaser(x, story_days=31)  # the test data has no stories in the last week


def digest_moves(events: DataFrame, most: int) -> list[Row]:
    """The chosen events in order: the best one first, then types not yet shown before others; one per model.

    A chosen model is out, so only the best event of each model and type can ever be chosen. Each
    row is a top-1 of those, which holds for any number of events.
    """
    order = (F.col("rk"), F.col("detected_at").desc(), F.col("id"))
    best = cut(first_per_key(events, ["model_id", "event_type"], *order))
    picks: list[Row] = []
    for _ in range(most):
        free = best.where(~F.col("model_id").isin([p["model_id"] for p in picks]))
        again = F.col("event_type").isin([p["event_type"] for p in picks])
        pick = top_k(free, 1, again, *order).collect()
        if not pick:
            break
        picks += pick
    return picks


def digest_teaser(x: Fixtures, rows: int = 3, days: int = 7, story_days: int = 7, newest: int | None = 100) -> DataFrame:
    """pos, kind, key, text, chip, tone, href: moves, the floor fact, catalog news, then top stories.

    One slot is kept for a story if there are any. The rules' own window is the newest 100 events
    of the week (newest=None: all of them), taken before small floor moves are dropped. Events of
    the test tables have no summary, so single events have no text.
    """
    m = x.models().select(F.col("id").alias("model_id"), "slug", "name", "vendor")
    e = legacy_free(recent(x.model_events(), "detected_at", as_of(), days)).join(m, "model_id")
    e = e if newest is None else top_k(e, newest, F.col("detected_at").desc(), F.col("id"))
    old, new = F.col("old_num").cast("string"), F.col("new_num").cast("string")
    e = e.where(S.is_material(F.col("event_type"), F.col("price_scope"), old, new))
    e = e.withColumn("rk", S.event_rank(F.col("event_type"), F.col("price_scope"))).withColumn("chip", S.event_delta(old, new)).withColumn("tone", S.event_tone(F.col("event_type"), old, new))
    e = cut(e)
    decayed = F.round(F.col("significance_score") / (1 + (F.unix_micros(as_of()) - F.unix_micros("first_published_at")) / 1e6 / 172800), 9)
    stories = top_k(recent(x.clusters(), "first_published_at", as_of(), story_days), min(3, rows), decayed.desc(), F.col("first_published_at").desc(), F.col("id")).select("id", "headline").collect()
    room = rows - 1 if stories else rows
    moves = digest_moves(e.where("event_type <> 'catalog'"), room)
    out = [("event", str(r["id"]), None, r["chip"], r["tone"], f"/models/{r['slug']}") for r in moves]
    if len(out) < room:
        out += [("event", f"floor-{r['slug']}", r["text"], r["chip"], "good", f"/models/{r['slug']}") for r in fact_row(x, m).collect() if r["slug"] not in {p["slug"] for p in moves}]
    if len(out) < room:
        out += [("event", str(r["id"]), r["text"], r["chip"], "neutral", r["href"]) for r in catalog_row(e.where("event_type = 'catalog'")).collect()]
    out += [("story", r["id"], r["headline"], None, "neutral", f"/story/{r['id']}") for r in stories]
    return x.spark.createDataFrame([(k, *r) for k, r in enumerate(out[:rows], 1)], "pos int, kind string, key string, text string, chip string, tone string, href string")


def fact_row(x: Fixtures, models: DataFrame) -> DataFrame:
    """The floor fact as a row of the digest: slug, text, chip."""
    f = floor_fact(x).join(joined_prices(x), "model_id").join(models, "model_id")
    low = F.col("floor_price_in").cast("double")
    price = F.when(low < 10, F.format_string("%.2f", low)).otherwise(F.format_string("%.0f", low))
    pct = S.half_up(S.discount_pct(F.col("floor_price_in"), F.col("vendor_price_in")))
    return f.select("slug", F.concat("name", F.lit(": $"), price, F.lit("/M via "), "floor_provider").alias("text"), F.concat(F.lit("-"), pct, F.lit("%")).alias("chip"))


def catalog_row(catalogs: DataFrame) -> DataFrame:
    """One row for all catalog events: id, text, chip, href. A lone event stands for itself, else the
    largest vendor's newest one leads (of equals the vendor met first)."""
    by = catalogs.groupBy(F.coalesce("vendor", F.lit("various vendors")).alias("vendor")).agg(F.count("*").alias("n"), F.min(F.struct((-F.unix_micros("detected_at")).alias("age"), "id", "slug")).alias("f"))
    total = by.agg(F.sum("n").alias("total"))  # one row
    top = top_k(by, 1, F.col("n").desc(), F.col("f")).crossJoin(F.broadcast(total))
    one = F.col("total") == 1
    text = F.when(F.col("n") > 1, F.concat("n", F.lit(" new "), "vendor", F.lit(" models in the tracker"))).otherwise(F.concat("total", F.lit(" new models in the tracker")))
    return top.select("f.id", F.when(~one, text).alias("text"), F.when(one, "NEW").alias("chip"), F.when(one, F.concat(F.lit("/models/"), "f.slug")).otherwise("/models/changes").alias("href"))


@q("M14_compare_pairs", PAIRS)
def _(x):
    return R.compare_pairs(cands(x), 5)


RISING = "SELECT '{part}' AS part, id, CAST(NULL AS VARCHAR) AS label FROM (SELECT w.*, max(eci) OVER ({by}ORDER BY {x}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM wide w WHERE eci IS NOT NULL AND {x} IS NOT NULL) WHERE m IS NULL OR eci > m"
QUADRANT = """SELECT id, CASE WHEN greatest(coverage, 1) >= mx THEN CASE WHEN eci >= my THEN 'hyped and delivering' ELSE 'hyped' END ELSE CASE WHEN eci >= my THEN 'quietly strong' ELSE 'quiet' END END AS quadrant
    FROM wide, (SELECT sqrt(greatest(100.0, 1.15 * greatest(10, max(coverage)))) AS mx, (min(eci) + max(eci)) / 2 AS my FROM wide WHERE eci IS NOT NULL) WHERE eci IS NOT NULL"""
DISCOUNTS = "SELECT model_id, round((1 - floor_price_in / vendor_price_in) * 100, 4) AS pct FROM prices WHERE vendor_price_in > 0 AND (1 - floor_price_in / vendor_price_in) * 100 >= 5 ORDER BY pct DESC, model_id LIMIT 10"


@q("M15_insight_frontiers", " UNION ALL ".join([*(RISING.format(part=k, x=v, by="") for k, v in (("price", "price_in"), ("time", "released_at"), ("context", "context_window"))), RISING.format(part="open and closed", x="price_in", by="PARTITION BY is_open_weight "),
    f"SELECT 'quadrant', id, quadrant FROM ({QUADRANT})", "SELECT 'value', id, NULL FROM (SELECT id FROM wide WHERE eci IS NOT NULL AND price_in + price_out > 0 ORDER BY eci / ((price_in + price_out) / 2) DESC, id LIMIT 12)", f"SELECT 'discount', model_id, NULL FROM ({DISCOUNTS})"]))
def _(x):
    w = cut(wide(x))
    part = lambda df, name, label=None: df.select(F.lit(name).alias("part"), "id", (F.lit(None) if label is None else F.col(label)).cast("string").alias("label"))
    lines = [part(R.running_max_frontier(w, v, "eci", "id"), k) for k, v in (("price", "price_in"), ("time", "released_at"), ("context", "context_window"))]
    lines += [part(R.running_max_frontier(w, "price_in", "eci", "id", ["is_open_weight"]), "open and closed"), part(quadrants(w.where("eci is not null")), "quadrant", "quadrant")]
    lines += [part(top_k(R.rank_models(w, "value"), 12, F.col("value").desc(), F.col("id")), "value"), part(discounts(x).withColumnRenamed("model_id", "id"), "discount")]
    return reduce(DataFrame.unionByName, lines)


@q("H31_quadrant", QUADRANT)
def _(x):
    return quadrants(wide(x).where("eci is not null"))


def quadrants(rows: DataFrame) -> DataFrame:
    """2x2 labels: the x border is the geometric middle of a log axis from 1, the y border the middle."""
    mid = rows.agg(F.sqrt(F.greatest(F.lit(100.0), 1.15 * F.greatest(F.lit(10), F.max("coverage")))).alias("mx"), ((F.min("eci") + F.max("eci")) / 2).alias("my"))
    high, strong = F.greatest(F.col("coverage"), F.lit(1)) >= F.col("mx"), F.col("eci") >= F.col("my")
    label = F.when(high & strong, "hyped and delivering").when(high, "hyped").when(strong, "quietly strong").otherwise("quiet")
    return rows.crossJoin(F.broadcast(mid)).select("id", label.alias("quadrant"))  # one row


@q("M20_best_at", "SELECT model_id, 'bucket' AS part, bucket AS name, score FROM bucket_scores WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY score DESC, bucket) <= 3 UNION ALL SELECT model_id, 'benchmark', benchmark, pct FROM (SELECT * FROM pct QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY pct DESC, benchmark) <= 5)")
def _(x):
    best = first_per_key(buckets(x).where("score >= 60"), ["model_id"], F.col("score").desc(), "bucket", k=3)
    strong = first_per_key(R.percentiles(year_scores(x)), ["model_id"], F.col("pct").desc(), "benchmark", k=5)
    return best.select("model_id", F.lit("bucket").alias("part"), F.col("bucket").alias("name"), F.col("score").cast("long").alias("score")).unionByName(strong.select("model_id", F.lit("benchmark").alias("part"), F.col("benchmark").alias("name"), F.col("pct").alias("score")))


MEASURED = " UNION ALL ".join(f"SELECT p.a, p.b, '{k}' AS attribute, {'true' if up else 'false'} AS up, CAST(u.{k} AS DOUBLE) AS va, CAST(v.{k} AS DOUBLE) AS vb FROM pairs p JOIN wide u ON u.slug = p.a JOIN wide v ON v.slug = p.b" for k, up in MEASURES.items())


@q("M21_pair_differences", f"SELECT a, b, attribute, va, vb, CASE WHEN (va > vb) = up THEN 'a' ELSE 'b' END AS winner FROM ({MEASURED}) WHERE va <> vb", pairs=PAIRS)
def _(x):
    """Every pair of the comparison pages."""
    pairs = cut(R.compare_pairs(cands(x), 5))
    named = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    w = cut(wide(x).join(named, F.col("slug") == F.col("key"), "left_semi").withColumn("key", F.col("slug")))
    a, b = (pairs.join(w, pairs[side] == w["key"]).drop("key", "slug") for side in ("a", "b"))
    return pair_differences(a, b, MEASURES, ["a", "b"])


def pair_differences(a: DataFrame, b: DataFrame, attributes: dict[str, bool], keys: list[str]) -> DataFrame:
    """keys, attribute, va, vb, winner for each attribute (True: higher is better) that differs between the rows of a and
    b with equal keys."""

    def long(df, v):
        return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), F.lit(up).alias("up"), F.col(k).cast("double").alias(v)) for k, up in attributes.items()])).alias("s")).select(*keys, "s.*")

    j = long(a, "va").join(long(b, "vb").drop("up"), [*keys, "attribute"]).where("va <> vb")
    return j.select(*keys, "attribute", "va", "vb", F.when((F.col("va") > F.col("vb")) == F.col("up"), "a").otherwise("b").alias("winner"))


@q("M27_registry_top_significance", "SELECT m.id, e.eci, m.price_in FROM models m LEFT JOIN eci e ON e.model_id = m.id ORDER BY m.significance DESC, m.id LIMIT 40")
def _(x):
    m = top_k(x.models(), 40, F.col("significance").desc(), F.col("id")).select("id", "price_in", F.col("id").alias("model_id"))
    return m.join(eci(x), "model_id", "left").select("id", "eci", "price_in")


@q("J10_link_coverage", """SELECT DISTINCT a.cluster_id, k.model_id FROM articles a JOIN clusters c ON c.id = a.cluster_id AND c.category <> 'uncategorized' AND (c.category = 'model-releases' OR c.significance_score >= 5) JOIN aliases k ON regexp_matches(lower(a.title), '(^|[^a-z0-9])' || regexp_escape(k.alias) || '($|[^a-z0-9.\\-])') OR length(regexp_replace(k.alias, '[^a-z0-9]', '', 'g')) >= 5 AND regexp_matches(regexp_replace(lower(a.title), '[^a-z0-9]', '', 'g'), regexp_replace(k.alias, '[^a-z0-9]', '', 'g') || '($|[^0-9])')""")
def _(x):
    c = x.clusters().where("category <> 'uncategorized' and (category = 'model-releases' or significance_score >= 5)")
    a = x.articles().join(c.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    hits = R.match_models(a, x.aliases(), "id", "title")
    return a.join(hits, "id").select("cluster_id", "model_id").distinct()


@q("J12_match_models", "SELECT DISTINCT a.id, k.model_id FROM articles a JOIN aliases k ON regexp_matches(lower(a.title), '(^|[^a-z0-9])' || regexp_escape(k.alias) || '($|[^a-z0-9.\\-])') OR length(regexp_replace(k.alias, '[^a-z0-9]', '', 'g')) >= 5 AND regexp_matches(regexp_replace(lower(a.title), '[^a-z0-9]', '', 'g'), regexp_replace(k.alias, '[^a-z0-9]', '', 'g') || '($|[^0-9])')")
def _(x):
    return R.match_models(x.articles(), x.aliases(), "id", "title")
