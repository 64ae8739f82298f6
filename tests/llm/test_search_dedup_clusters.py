"""Ranked search, exact dedup and centroid clustering against plain versions and their twins."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import lodestory.llm.signature_search as G
from lodestory.llm import queries as Q
from lodestory.llm.centroids import cluster_vectors, nearest_centroids
from lodestory.llm.digest_index import DigestIndex, digests, exact_duplicates, keep_new
from lodestory.llm.shared import scratch
from lodestory.llm.signature_search import ranked_search, search_signatures, write_signature_index
from tests.compare import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_exact_dedup", "op13_centroid_clustering"])
def test_twin(spark, name):
    assert spark_rows(Q.QUERIES[name](spark, SF)) == duck_rows(connect(SF), Q.ORACLE_SQL[name])


# ranked search


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def brute_search(docs, items, k=50):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    of = defaultdict(set)
    for i, t in items:
        if i is not None:
            of[i] |= set(words(t))
    out = set()
    for i, terms in of.items():
        scores = []
        for d, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0 and d is not None:
                scores.append((-s, d))
        out |= {(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])}
    return out


def found(df):
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()}


def test_search_edges(spark):
    docs = [(1, "Alpha beta beta"), (2, "alpha BETA beta"), (3, None), (4, ""), (5, "... 12 ÄÖ äö é"), (6, "gamma " * 3000 + "alpha"), (7, "x" * 200_000), (8, "beta"), (8, "beta"), (None, "alpha alpha alpha"), (9, "aé gamma-alpha_beta")]
    items = [(1, "ALPHA beta"), (2, None), (3, "nothing here"), (4, "Äö ÄÖ x"), (5, "gamma"), (5, "delta alpha"), (None, "alpha"), (6, ""), (7, "x" * 200_000)]
    frame = spark.createDataFrame([(i, t, 0.5, "r") for i, t in docs], "doc_id int, text string, score double, rank string")
    got = ranked_search(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and found(got) == brute_search(docs, items)
    assert found(ranked_search(frame, spark.createDataFrame(items, "item_id long, text string"), k=2)) == brute_search(docs, items, 2)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert not found(ranked_search(none, spark.createDataFrame(items, "item_id long, text string")))
    assert not found(ranked_search(frame, spark.createDataFrame([], "item_id long, text string")))
    with pytest.raises(TypeError, match="doc_id must be an integer"):
        ranked_search(frame.withColumn("doc_id", F.col("doc_id").cast("string")), spark.createDataFrame(items, "item_id long, text string"))


def test_search_equals_brute_force_with_little_rescoring(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{k}" for k in range(3000)])
    share = 1 / np.arange(1, 3001)
    share /= share.sum()
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(20, 400), p=share))) for i in range(3000)]
    docs += [(3000 + i, docs[7][1]) for i in range(300)]  # a hot group
    items = [(i, " ".join(docs[int(rng.integers(0, 3000))][1].split()[:15])) for i in range(25)]
    monkeypatch.setattr(G, "BLOCK_BYTES", 1 << 17)
    monkeypatch.setattr(G, "QUERY_BYTES", 500)  # several passes over the index
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute_search(docs, items, 10)
    index = write_signature_index(frame, scratch(spark))
    assert index.count() >= 3
    assert found(search_signatures(spark, index, spark.createDataFrame(items, "item_id long, text string"), k=10)) == want
    # one task over all blocks: most documents are excluded by their bounds
    n_docs, n_terms = len(docs), sum(len(t.split()) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(t.split()))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    q = G.Queries([i for i, _ in items], [sorted(set(t.split())) for _, t in items], weight)
    best = G.Best(len(items), 10)
    for b in index.toArrow().to_batches():
        for block in G._blocks([b], n_docs, n_terms):
            G.search_block(block, q, best)
    assert {(q.items[i], r + 1, int(d), int(s)) for i in range(len(items)) for r, (s, d) in enumerate(zip(best.score[i], best.ids[i], strict=True))} == want
    assert best.scored < 0.2 * best.seen


def test_bounds_are_never_under_the_scores():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"t{k}" for k in range(40)], rng.integers(1, 900))) for _ in range(60)] + ["t1 " * 5000, "only"]
    row = G.index_block(pa.array(range(len(texts))), pa.array(texts))
    block = G.Block(row, 62, sum(len(t.split()) for t in texts))
    terms = [f"t{k}" for k in range(40)]
    q = G.Queries([0], [terms], dict.fromkeys(terms, 7))
    code = {t: k for k, t in enumerate(row["terms"].to_pylist())}
    gain = np.concatenate(list(block.bounds(q, np.arange(len(q.terms)))), 1)
    for k, t in enumerate(q.terms):
        worth = np.zeros(len(row["terms"]), np.int64)
        worth[code[t]] = 1
        exact = block.exact(np.arange(len(row["n"])), worth)
        assert (gain[k] >= exact).all() and (exact > 0).sum() <= (gain[k] > 0).sum()


# exact dedup


def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(SMALL)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, keep[n], len(groups[n]), i == keep[n], hashlib.sha256(n.encode()).hexdigest()) for i, t in rows for n in [(t or "").translate(SMALL)])


def test_dedup_edges_and_hot_groups(spark):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "Äa"), (6, "äA"), (None, "a b"), (None, "lone"), (None, "LONE"), (9, "x" * 300_000), (8, "X" * 300_000), (10, "same"), (10, "same")]
    rows += [(100 + k, "hot TEXT" if k % 3 else "Hot text") for k in range(3000)] + [(5000 + k, f"text {k % 1500}") for k in range(3000)]
    frame = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, digest string, kept boolean").repartition(5)
    for arrivals in (1, 3):
        got = exact_duplicates(frame, DigestIndex(spark, scratch(spark)), arrivals=arrivals)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert Counter(map(tuple, got.collect())) == brute_dedup(rows)
    assert not exact_duplicates(frame.limit(0), DigestIndex(spark, scratch(spark))).collect()


def test_index_persists_and_takes_arrivals(spark):
    path = scratch(spark)
    first = spark.createDataFrame([(1, "a", "u"), (2, "A", "v"), (3, "b", "w")], "doc_id long, text string, keep_id string")
    second = spark.createDataFrame([(9, "a", "x"), (4, "c", "y"), (4, "c", "y"), (5, None, "z")], "doc_id long, text string, keep_id string")
    index = DigestIndex(spark, path, buckets=3)
    assert sorted(map(tuple, keep_new(first, index, "monday").collect())) == [(2, "A", "v"), (3, "b", "w")]
    spark.sql(f"DROP TABLE {index.name}")  # as a later session: only the folder is left
    again = DigestIndex(spark, path)
    assert again.buckets == 3 and again.entries().count() == 2
    kept = keep_new(second, again, "tuesday")
    assert kept.columns == first.columns and sorted(map(tuple, kept.collect()), key=str) == [(4, "c", "y"), (5, None, "z")]
    # the same arrival once more adds nothing and answers alike
    assert sorted(map(tuple, keep_new(second, again, "tuesday").collect()), key=str) == [(4, "c", "y"), (5, None, "z")]
    assert again.entries().count() == 4 and not keep_new(first, again, "wednesday").collect()
    plan = digests(second).join(again.entries().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    # sorted and merged, and only the new side moves
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan and plan.count("Exchange") == 1


# centroids


def brute_clusters(rows, clusters, rounds, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    c = [list(v) for _, v in start]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        who = assign()
        for k in range(len(c)):
            mine = [v for (_, v), (_, w) in zip(kept, who, strict=True) if w == k]
            if mine:
                c[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    who = assign()
    inertia = Counter()
    for d, k in who:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, who, strict=True))


@pytest.mark.parametrize("clusters", [1, 7, 300])
def test_clusters_equal_plain_rounds(spark, clusters):
    rng = np.random.default_rng(clusters)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64) + (i % 5)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(80)] + [(3, rows[3][1])]  # ties and repeats
    rows += [(300, None), (301, [1.0] * 63), (302, [None] + [1.0] * 63), (303, [float("nan")] * 64), (304, [float("inf")] + [0.0] * 63), (305, []), (None, [0.5] * 64), (306, [-0.001] * 64)]
    frame = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(3)
    got = cluster_vectors(frame, clusters=clusters, rounds=3)
    assert Counter(map(tuple, got.drop("n_measured").collect())) == brute_clusters(rows, clusters, 3)
    assert got.agg(F.max("n_measured")).first()[0] <= clusters


def test_clusters_of_nothing_and_of_too_much(spark):
    assert not cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect()
    with pytest.raises(Exception, match="component beyond"):
        cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()


def test_walk_stops_early_and_keeps_ties():
    rng = np.random.default_rng(9)
    c = rng.integers(-1000, 1000, (500, 3))
    c[400:450] = c[:50]  # equal centroids: the smaller number wins
    x = np.concatenate([c + rng.integers(-3, 4, c.shape), rng.integers(-(1 << 24), 1 << 24, (50, 3))])
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    who, best, measured = nearest_centroids(x, c)
    assert (who == d.argmin(1)).all() and (best == d.min(1)).all()
    assert measured[:500].mean() < 100
