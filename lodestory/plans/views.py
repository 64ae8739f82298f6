"""The fixture views in DuckDB's SQL, as common table expressions for oracle queries."""

from __future__ import annotations

import re

from lodestory.sources.fixtures import CATEGORIES

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _category(text: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{c}'" for c, words in CATEGORIES.items())
    return f"CASE {whens} END"


def _slug(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'model')"


SCORE = "CASE WHEN {x} <= 0 THEN 1.0 ELSE least(greatest(round_even(2.4 * ln(1 + {x} / 1.43), 0), 1.0), 10.0) END"

VIEWS = {
    "sources": "SELECT 'src' || k AS name, 'org' || (k % 8) AS organization, [10, 7, 5, 3][CAST(k % 4 + 1 AS INT)] AS authority, k % 3 = 0 AS ai_filter FROM range(20) t(k)",
    "articles_0": """SELECT d.doc_id AS id, substr(trim(split_part(d.text, chr(10), 1)), 1, 120) AS title, d.text AS body_excerpt, d.source AS source_name,
        'https://news.example/' || md5(d.text) AS source_url, e.ts AS published_at, s.authority, s.organization, s.ai_filter, d.lang,
        CASE WHEN e.event_type <> 'error' THEN 1 + CAST(floor(e.value) AS INT) % 10 END AS impact,
        CASE WHEN v.label IS NOT NULL THEN v.label || '-' || (d.doc_id // 40) END AS cluster_id
        FROM documents d JOIN events e ON e.event_id = d.doc_id * 5 JOIN sources s ON s.name = d.source LEFT JOIN embeddings v ON v.vec_id = d.doc_id""",
    "articles": f"SELECT *, coalesce({_category('title')}, {_category('body_excerpt')}, 'uncategorized') AS category FROM articles_0",
    "org_max": "SELECT cluster_id, organization, max(authority) AS a FROM articles WHERE cluster_id IS NOT NULL GROUP BY ALL",
    "org_ranked": "SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY a DESC, organization) AS r FROM org_max",
    "org_scores": "SELECT cluster_id, sum(a * pow(0.6, r - 1)) AS base, 1 + 0.25 * greatest(0.0, sum(least(1.0, a / 7.0)) - 1) AS breadth FROM org_ranked GROUP BY 1",
    "cluster_meta": "SELECT cluster_id, count(*) AS article_count, min(published_at) AS first_published_at, coalesce(max(impact), 5) AS max_impact, count(DISTINCT source_name) AS source_count, bool_and(source_name LIKE 'src1%') AS paper_only FROM articles WHERE cluster_id IS NOT NULL GROUP BY 1",
    "peak": "SELECT cluster_id, arg_min(day, (-n, day)) AS peak_date FROM (SELECT cluster_id, CAST(published_at AS DATE) AS day, count(*) AS n FROM articles WHERE cluster_id IS NOT NULL GROUP BY ALL) GROUP BY 1",
    "cat_votes": "SELECT cluster_id, category, count(*) AS n, min((published_at, id)) AS f FROM articles WHERE cluster_id IS NOT NULL AND category <> 'uncategorized' GROUP BY ALL",
    "cat_major": "SELECT cluster_id, category FROM cat_votes QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f, category) = 1",
    "headlines": "SELECT cluster_id, title AS headline FROM articles WHERE cluster_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY authority DESC, published_at, id) = 1",
    "clusters": f"""SELECT m.cluster_id AS id, headline, coalesce(c.category, 'uncategorized') AS category, {SCORE.format(x="(base * (max_impact / 5.0) * breadth)")} AS significance_score, base * (max_impact / 5.0) * breadth AS raw_score,
        m.first_published_at, peak_date, m.article_count, m.max_impact, m.source_count, m.paper_only
        FROM cluster_meta m JOIN org_scores USING (cluster_id) JOIN peak USING (cluster_id) JOIN headlines USING (cluster_id) LEFT JOIN cat_major c USING (cluster_id)""",
    "vectors": "SELECT a.id, a.published_at, a.source_name, a.cluster_id, e.embedding AS vector FROM articles a JOIN embeddings e ON a.id = e.vec_id",
    "models_0": f"SELECT p_partkey AS id, p_name AS name, {_slug('p_name')} AS slug0, p_brand AS vendor, p_type AS family, p_size * 1000 AS context_window, round(p_retailprice / 100, 4) AS price_in, round(3 * round(p_retailprice / 100, 4), 4) AS price_out, DATE '2022-12-01' + CAST(7 * p_partkey % 420 AS INT) AS released_at, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_open_weight, p_partkey % 11 AS significance FROM part",
    "models": "SELECT * EXCLUDE (slug0, r), CASE WHEN r > 1 THEN slug0 || '-' || r ELSE slug0 END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY slug0 ORDER BY id) AS r FROM models_0)",
    "model_benchmarks": "SELECT l_partkey AS model_id, 'bench' || l_linenumber AS benchmark, max(l_quantity) / 50 AS score, CASE WHEN l_linenumber = 1 THEN 'index' ELSE '%' END AS unit, CASE WHEN l_linenumber % 2 = 1 THEN 'primary' ELSE 'secondary' END AS source FROM lineitem GROUP BY l_partkey, l_linenumber",
    "bucket_map": "SELECT * FROM (VALUES ('coding','bench2'),('coding','bench3'),('math','bench4'),('reasoning','bench5'),('reasoning','bench6'),('agentic','bench3'),('agentic','bench7')) t(bucket, benchmark)",
    "offers": """SELECT l_partkey AS model_id, 'Brand#' || (1 + l_suppkey % 25) AS provider, p_brand AS author, CAST(l_shipdate AS TIMESTAMP) AS sample_ts, l_extendedprice / l_quantity / 100 AS price_in,
        l_extendedprice / l_quantity / 100 * (1 + 10 * l_tax) AS price_out, CASE WHEN l_discount >= 0.09 THEN 0.5 ELSE 0.0 END AS discount, ['fp8', 'fp4', 'bf16', NULL][CAST(l_linenumber % 4 + 1 AS INT)] AS quant,
        CAST(l_quantity * 20000 AS BIGINT) AS context, CASE WHEN l_returnflag = 'R' THEN -2 ELSE 0 END AS status, 'brand' || l_suppkey || CASE WHEN l_linenumber = 7 THEN '/flex' ELSE '/std' END AS tag, l_orderkey * 10 + l_linenumber AS ordinal
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "price_samples": "SELECT l_partkey AS model_id, CAST(l_shipdate AS TIMESTAMP) AS sample_ts, CASE WHEN l_linenumber % 5 <> 0 THEN ceil(l_quantity / 25) END AS vendor_in, CASE WHEN l_linenumber % 5 <> 0 THEN ceil(l_quantity / 17) END AS floor_in FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_shipdate ORDER BY l_orderkey, l_linenumber) = 1",
    "model_events": "SELECT event_id AS id, user_id AS model_id, CASE event_type WHEN 'purchase' THEN 'price' WHEN 'view' THEN 'benchmark' WHEN 'click' THEN 'context' WHEN 'signup' THEN 'catalog' ELSE 'deprecation' END AS event_type, value AS old_num, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS new_num, CASE event_id % 3 WHEN 1 THEN 'vendor' WHEN 2 THEN 'floor' END AS price_scope, ts AS detected_at FROM events",
    "model_clusters": "SELECT DISTINCT e.user_id AS model_id, a.cluster_id FROM events e JOIN articles a ON a.id = e.event_id WHERE a.cluster_id IS NOT NULL",
    "pipeline_runs": "SELECT event_id AS id, ts AS ran_at, CAST(floor(value) AS BIGINT) AS articles_ingested, CAST(floor(value / 2) AS BIGINT) AS clusters_updated FROM events WHERE event_type = 'signup' AND user_id % 100 = 0",
    "waitlist": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'User' ELSE 'user' END || user_id AS email, CASE WHEN event_type IN ('signup', 'purchase') THEN 'digest-' || event_type ELSE event_type END AS source, CASE WHEN event_id % 3 <> 0 THEN props END AS stack, ts AS created_at FROM events",
    "aliases": "SELECT alias, min(item_id) AS model_id FROM (SELECT item_id, array_to_string(list_slice(string_split(lower(text), ' '), 1, 3), ' ') AS alias FROM benchmark) WHERE length(alias) >= 8 GROUP BY 1",
}


def with_views(sql: str, own: dict[str, str] | None = None) -> str:
    """The query behind the views that it needs, in their order."""
    every = {**VIEWS, **(own or {})}
    needed: set[str] = set()

    def visit(text: str, self: str = "") -> None:
        for name in every:
            if name != self and name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(every[name], name)

    visit(sql)
    parts = [f"{n} AS ({q})" for n, q in every.items() if n in needed]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql
