"""Queries that apply the scalar rules to table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestory.functions import scalars as S
from lodestory.functions import vocabulary as V
from lodestory.plans.catalog import query
from lodestory.plans.views import SCORE
from lodestory.sources.fixtures import CATEGORIES, AS_OF

P = "SELECT p_partkey AS id, {} FROM part"


def part(name: str, sql: str, column, alias: str) -> None:
    """A rule over the parts table: one id and one value per row."""

    @query(name, P.format(f"{sql} AS {alias}"))
    def _(x):
        return x.table("part").select(F.col("p_partkey").alias("id"), column().alias(alias))


def event(name: str, sql: str, column, alias: str) -> None:
    @query(name, f"SELECT event_id AS id, {sql} AS {alias} FROM events")
    def _(x):
        return x.table("events").select(F.col("event_id").alias("id"), column().alias(alias))


def article(name: str, sql: str, column, alias: str) -> None:
    @query(name, f"SELECT id, {sql} AS {alias} FROM articles")
    def _(x):
        return x.articles().select("id", column().alias(alias))


c, lit = F.col, F.lit
K = "lower({0})"


event("H1_normalize_score", SCORE.format(x="value"), lambda: S.normalize_score(c("value")), "score")
article("H2_effective_threshold", "CASE WHEN source_name LIKE 'src1%' THEN 0.55 ELSE 0.60 END", lambda: S.effective_threshold(c("source_name"), paper_prefix="src1", news=0.60, paper=0.55), "threshold")
article("H4_categorize", "category", lambda: S.categorize(c("title"), c("body_excerpt"), CATEGORIES), "category")
article("H6_truncate_words", "CASE WHEN len(list_filter(regexp_split_to_array(body_excerpt, '\\s+'), lambda w: w <> '')) > 20 THEN array_to_string(list_slice(list_filter(regexp_split_to_array(body_excerpt, '\\s+'), lambda w: w <> ''), 1, 20), ' ') || '…' ELSE body_excerpt END", lambda: S.truncate_words(c("body_excerpt"), 20), "excerpt")
part("H7_normalize_key", "regexp_replace(lower(regexp_replace(regexp_replace(p_name || '_x' || p_size, '_[A-Za-z0-9]+$', ''), '\\d{4}-\\d{2}-\\d{2}', '', 'g')), '[^a-z0-9]', '', 'g')", lambda: S.normalize_key(F.concat("p_name", lit("_x"), "p_size")), "k")
part("H8_slugify", "trim(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-')", lambda: S.slugify(F.concat("p_type", lit(" / "), "p_name")), "slug")
part("H9_derive_family", "CASE WHEN contains(lower(replace(p_name, ' ', '')), 'blue') THEN 'Blue' WHEN contains(lower(replace(p_name, ' ', '')), 'ring') THEN 'Ring' END", lambda: S.derive_family(c("p_name"), [("blue", "Blue"), ("ring", "Ring")]), "family")
part("H10_format_parameters", "regexp_replace(regexp_replace(printf('%.1f', CASE WHEN v >= 1e12 THEN v / 1e12 WHEN v >= 1e9 THEN v / 1e9 ELSE v / 1e6 END), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || CASE WHEN v >= 1e12 THEN 'T' WHEN v >= 1e9 THEN 'B' ELSE 'M' END".replace("v ", "(p_size * pow(10, 6 + p_partkey % 7)) "), lambda: S.format_parameters((c("p_size") * F.pow(lit(10.0), 6 + c("p_partkey") % 7)).cast("string")), "size")
part("H11_coerce_tristate", "CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN NULL ELSE true END", lambda: S.coerce_tristate(F.element_at(F.array(lit(" Yes"), lit("NO "), lit("maybe"), lit("1")), (c("p_partkey") % 4 + 1).cast("int"))), "open")
part("H11_tristate_access", "CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END", lambda: S.tristate_access(F.element_at(F.array(lit("Open weights (restricted)"), lit("API access"), lit("Hosted only"), lit("unknown")), (c("p_partkey") % 4 + 1).cast("int"))), "open")
part("H12_clean_description", "CASE p_partkey % 3 WHEN 0 THEN p_name || '. ' || p_type || '.' WHEN 1 THEN p_name || ' is good.' ELSE p_name || '…' END", lambda: S.clean_description(F.when(c("p_partkey") % 3 == 0, F.concat("p_name", lit(". "), "p_type", lit(". And then the..."))).when(c("p_partkey") % 3 == 1, F.concat(lit(" "), "p_name", lit(" is good."))).otherwise(F.concat("p_name", lit("...")))), "description")
part("H13_price_per_million", "CASE WHEN p_size > 5 THEN CAST(p_size AS DOUBLE) / 10 END", lambda: S.price_per_million(F.when(c("p_size") > 5, F.format_string("%.8f", c("p_size") * 1e-7)).otherwise(lit("-1"))), "price")
part("H14_provider_matches_author", "starts_with('brand' || (p_partkey % 25 + 1), regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g')) OR starts_with(regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g'), 'brand' || (p_partkey % 25 + 1))", lambda: S.provider_matches_author(F.concat(lit("Brand #"), c("p_partkey") % 25 + 1), c("p_brand")), "matches")
part("H15_split_vendor_name", "p_brand || '|' || p_name", lambda: F.concat_ws("|", *S.split_vendor_name(F.concat("p_brand", lit(": "), "p_name"))), "parts")
part("H16_catalog_key", "regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')", lambda: S.catalog_key(F.concat("p_brand", lit("/"), "p_name", F.when(c("p_size") > 20, ":free").otherwise(""))), "k")
part("H16_effort_key", "regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')", lambda: S.normalize_key(S.strip_parens(F.concat("p_name", lit(" (high)")))), "k")
article("H17_strip_publisher_suffix", "CASE WHEN ends_with(title || CASE WHEN id % 2 = 0 THEN ' - ' || source_name ELSE '' END, ' - ' || source_name) THEN title ELSE title END", lambda: S.strip_publisher(F.concat("title", F.when(c("id") % 2 == 0, F.concat(lit(" - "), "source_name")).otherwise("")), c("source_name")), "title")
article("H17_publisher_matches_org", "contains(lower(source_name), lower(organization)) OR contains(lower(organization || source_name), lower(source_name))", lambda: S.publisher_matches(c("source_name"), F.concat("organization", "source_name")), "matches")
article("H18_attribute_publisher", "CASE WHEN contains('org1', lower(organization)) OR contains(lower(organization), 'org1') THEN authority ELSE least(authority, 3) END", lambda: F.when(S.publisher_matches(lit("org1"), c("organization")), c("authority")).otherwise(F.least(c("authority"), lit(3))), "authority")
event("H19_is_rolling_build", "CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE true END", lambda: S.is_rolling_build(F.element_at(F.array(lit("b4321"), lit("v1.2"), lit("abcdef0"), lit("main")), (c("event_id") % 4 + 1).cast("int")), lit("main")), "rolling")
event("H20_clean_release_body", "'Fix ' || event_id || chr(10) || chr(10) || 'done'", lambda: S.clean_release_body(F.concat(lit("Fix "), "event_id", lit("\n`x`\n\n\n```py\ncode\n```\ndone\n- abcdef1234 hash"))), "body")
event("H21_to_utc_timestamp_any", "CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000000 WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(ts) // 1000000 - 3600 END", lambda: F.floor(F.unix_micros(S.to_utc_timestamp_any(F.when(c("event_id") % 2 == 0, F.floor(F.unix_micros(c("ts").cast("timestamp")) / 1000000).cast("string")).when(c("event_id") % 3 == 0, lit("soon")).otherwise(F.concat(F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), lit("+01:00"))))) / 1000000), "seconds")
event("H22_within_window", "CAST(ts AS DATE) >= DATE '2024-01-31' - 25", lambda: S.within_window(c("ts").cast("string"), AS_OF, 25), "inside")
event("H24_event_rank", "CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 3 = 1 THEN 0 ELSE 1 END WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END", lambda: S.event_rank(F.element_at(F.create_map(*[lit(z) for z in ("purchase", "price", "view", "benchmark", "click", "context", "signup", "catalog", "error", "x")]), c("event_type")), F.when(c("event_id") % 3 == 1, "vendor")), "rank")
event("H24_event_delta", "CASE WHEN event_id % 5 = 0 THEN '-50.0%' WHEN event_id % 5 = 4 THEN NULL ELSE '+' || (event_id % 5 * 100) || '.0%' END", lambda: S.event_delta(lit("4"), F.when(c("event_id") % 5 == 0, "2").when(c("event_id") % 5 == 4, "x").otherwise((4 + 4 * (c("event_id") % 5)).cast("string"))), "delta")
event("H24_tone", "CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'good' ELSE 'bad' END WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'bad' ELSE 'good' END ELSE 'neutral' END", lambda: S.event_tone(F.when(c("event_type") == "purchase", "price").when(c("event_type") == "view", "benchmark").otherwise("other"), lit("4"), F.when(c("event_id") % 2 == 0, "3").otherwise("5")), "tone")
event("H25_impact_tier", "CASE WHEN value >= 9 THEN 'major' WHEN value >= 7 THEN 'notable' WHEN value >= 5 THEN 'minor' ELSE 'routine' END", lambda: S.tier(c("value"), (9, 7, 5), ("major", "notable", "minor", "routine")), "tier")
event("H25_score_tier", "CASE WHEN value >= 8.5 THEN 'high' WHEN value >= 7 THEN 'mid' ELSE 'low' END", lambda: S.tier(c("value"), (8.5, 7), ("high", "mid", "low")), "tier")
part("H26_value_index", "round(p_size / ((p_retailprice + 3 * p_retailprice) / 2), 8)", lambda: F.round(c("p_size") / S.blended_price(c("p_retailprice"), 3 * c("p_retailprice")), 8), "v")
part("H27_discount_pct", "round((1 - p_size / p_retailprice) * 100, 4)", lambda: F.round(S.discount_pct(c("p_size"), c("p_retailprice")), 4), "pct")
part("H28_format_context", "CASE WHEN p_size * 40000 >= 1000000 THEN printf('%.1fM', p_size * 40000 / 1e6) ELSE (p_size * 40) || 'K' END", lambda: S.format_context(c("p_size") * 40000), "context")
part("H28_format_score", "CASE p_partkey % 3 WHEN 0 THEN printf('%.1f%%', p_size / 63.0 * 100) WHEN 1 THEN CASE WHEN p_size * 4 >= 60 THEN printf('%.1fh', p_size * 4 / 60) ELSE (p_size * 4) || 'm' END ELSE CAST(p_size AS VARCHAR) END", lambda: F.when(c("p_partkey") % 3 == 0, S.format_score(c("p_size") / 63, lit("%"))).when(c("p_partkey") % 3 == 1, S.format_score(c("p_size") * 4, lit("min"))).otherwise(S.format_score(c("p_size"), lit("elo"))), "shown")
part("H29_norm_vendor", "CASE p_partkey % 3 WHEN 0 THEN 'google' WHEN 1 THEN 'zai' ELSE regexp_extract(lower(p_brand), '^[^\\s(]*') END", lambda: S.norm_vendor(F.when(c("p_partkey") % 3 == 0, F.concat(lit("Google "), "p_brand")).when(c("p_partkey") % 3 == 1, lit("Z.ai (x)")).otherwise(F.concat("p_brand", lit(" (y)")))), "vendor")
part("H30_expand_synonyms", "CASE p_partkey % 3 WHEN 0 THEN 'kimi,moonshot' WHEN 1 THEN 'Meta ,llama,meta ai' ELSE p_brand END", lambda: F.array_join(S.expand_synonyms(F.when(c("p_partkey") % 3 == 0, "kimi").when(c("p_partkey") % 3 == 1, "Meta ").otherwise(c("p_brand"))), ","), "terms")
part("H33_sentence_summary_clean", "p_name || ' is out'", lambda: S.clean_summary(F.concat(lit("``` TL;DR:  "), "p_name", lit("\n is   out ```"))), "summary")


@query("H3_cosine_distance", "SELECT a.vec_id AS id, round(1 - list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 6) AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def _(x):
    e = x.table("embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select(F.col("vec_id").alias("id"), F.round(S.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("d"))


@query("H5_strip_html", "SELECT page_id AS id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages")
def _(x):
    return x.table("pages").select(F.col("page_id").alias("id"), S.strip_html(F.col("html")).alias("text"))


@query("H32_is_english", "SELECT doc_id AS id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 10 OR lang = 'en' AS english FROM documents")
def _(x):
    return x.table("documents").select(F.col("doc_id").alias("id"), S.is_english(F.col("text"), F.col("lang")).alias("english"))


@query("H23_build_normalized_article", "SELECT id, trim(title) AS title, source_url, CASE WHEN len(list_filter(regexp_split_to_array(body_excerpt, '\\s+'), lambda w: w <> '')) > 30 THEN array_to_string(list_slice(list_filter(regexp_split_to_array(body_excerpt, '\\s+'), lambda w: w <> ''), 1, 30), ' ') || '…' ELSE body_excerpt END AS excerpt, category FROM articles WHERE title <> '' AND source_url <> ''")
def _(x):
    return build_article(x.articles(), 30)


def build_article(rows, most: int = 150):
    """Trimmed title, excerpt and category; rows without title, url or time are dropped."""
    out = rows.withColumn("title", F.trim("title")).where("title <> '' and source_url <> '' and published_at is not null")
    return out.select("id", "title", "source_url", S.truncate_words(F.col("body_excerpt"), most).alias("excerpt"), S.categorize(F.col("title"), F.col("body_excerpt"), CATEGORIES).alias("category"))


@query("L1_sql_functions", f"SELECT event_id AS id, {SCORE.format(x='value')} AS s, 'k' || (event_id % 7) AS k FROM events")
def _(x):
    S.register_sql_functions(x.spark)
    x.table("events").createOrReplaceTempView("lodestory_events")
    return x.spark.sql("SELECT event_id AS id, norm_score(value) AS s, key_of(concat('K-', event_id % 7, '_high')) AS k FROM lodestory_events")
