"""The text operators as named queries with production parameters over whole tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestory.llm.centroids import cluster_vectors
from lodestory.llm.decontaminate import benchmark_hits
from lodestory.llm.digest_index import DigestIndex, exact_duplicates
from lodestory.llm.language_id import identify_language, train_language_model
from lodestory.llm.near_dedup import near_duplicate_classes
from lodestory.llm.nearest import nearest_neighbours
from lodestory.llm.packing import pack_documents
from lodestory.llm.shared import held_out, scratch, table
from lodestory.llm.signature_search import ranked_search
from lodestory.llm.suffix_dedup import remove_repeats
from lodestory.llm.token_counts import prefix_token_counts
from lodestory.llm.token_store import read_token_store, write_token_store
from lodestory.llm.toxicity import score_toxicity, train_toxicity_model
from lodestory.llm.url_trust import judge_urls

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity_model(docs, table(spark, sf_dir, "labels"), train_language_model(docs))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ","), 256)
    return hits.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, train_language_model(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), budget=2048)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=2048, end_id=0)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_token_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), spaces=False, end_id=1)
    return read_token_store(spark, path, with_ids=False)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"), similarity=0.8)


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), DigestIndex(spark, scratch(spark)))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), clusters=40, rounds=5, seed=2, scale=256).drop("n_measured")


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_token_counts": op4_token_counts,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_token_store": op7_token_store,
    "op8_language_id": op8_language_id,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_url_trust": op10_url_trust,
    "op11_ranked_search": op11_ranked_search,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
}
#: Words are runs outside the listed ASCII ranges after lower-casing A-Z; a window is ten words or
#: a whole shorter item; a document word is hit if any occurrence of a window covers it.
DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, greatest(len(w) - 9, least(1, len(w))) + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS i FROM d, sizes)),
hits AS (SELECT p.doc_id, p.i, p.k, win.item_id FROM places p JOIN win ON win.k = p.k AND win.s = p.s),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

#: Terms with A-Z lower-cased; integer division throughout but in the weight.
SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM n, total),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 50"""

DEDUP_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256)"""


def _clustering_sql(clusters: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """The rounds one after another, in integers of 64 bits; a floor is a division that rounds down."""
    parts = [
        "p AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "x AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS d, unnest(q) AS v FROM p)",
        f"c0 AS MATERIALIZED (SELECT cluster, unnest(range(1, 65)) AS d, unnest(q) AS c FROM (SELECT q, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS cluster FROM p QUALIFY cluster < {clusters}))",
    ]
    for k in range(rounds + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT vec_id, cluster, distance FROM (SELECT vec_id, cluster, sum((v - c) * (v - c))::BIGINT AS distance FROM x JOIN c{k} USING (d) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)")
        if k < rounds:
            parts.append(f"s{k} AS (SELECT cluster, d, sum(v)::BIGINT AS s, count(*) AS n FROM a{k} JOIN x USING (vec_id) GROUP BY ALL)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT cluster, d, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{k} LEFT JOIN s{k} USING (cluster, d))")
    parts.append(f"digest AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN digest USING (cluster)"


ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": DECONTAMINATION_SQL,
    "op11_ranked_search": SEARCH_SQL,
    "op12_exact_dedup": DEDUP_SQL,
    "op13_centroid_clustering": _clustering_sql(),
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
