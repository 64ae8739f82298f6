"""Exact neighbours with blocks around pivots, against all pairs."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import lodestory.operators.vectors as X
from lodestory.operators import pivots as P


def frame(spark, seed, n, centres, spread, hours=300, copies=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 16))
    middle /= np.linalg.norm(middle, axis=1)[:, None]
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=float(rng.integers(0, hours))), (middle[i % centres] + rng.normal(size=16) * spread).tolist()) for i in range(n)]
    rows += [(n + i, datetime(2024, 1, 1) + timedelta(hours=5), rows[0][2]) for i in range(copies)]
    rows += [(n + copies, rows[0][1], [0.0] * 16)]
    return rows, spark.createDataFrame(rows, "id long, published_at timestamp, vector array<double>")


def all_pairs(rows, below, hours=48):
    v = np.array([r[2] for r in rows])
    norm = np.linalg.norm(v, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = 1 - (v @ v.T) / (norm[:, None] * norm[None])
    t = np.array([r[1].timestamp() for r in rows])
    near = (d < below) & (np.abs(t[:, None] - t[None]) <= hours * 3600) & ~np.eye(len(rows), dtype=bool)
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)}


@pytest.mark.parametrize(("spread", "below", "copies"), [(0.01, 0.05, 0), (0.3, 0.4, 60)])
def test_crowded_windows_equal_all_pairs(spark, monkeypatch, spread, below, copies):
    rows, df = frame(spark, 1, 500, 12, spread, copies=copies)
    monkeypatch.setattr(P, "BLOCK_ROWS", 20)
    v = X.timed(df).withColumn("_thr", F.lit(below))
    got = {(r["id"], r["id_2"]) for r in X.time_pairs(v, v, 48, [], below="_thr").select("id", "id_2").collect()}
    assert got and got == all_pairs(rows, below)
    # one side alone, with its own rows
    few = v.where("id % 7 = 0")
    got = {(r["id"], r["id_2"]) for r in X.time_pairs(few, v, 48, [], below=below).select("id", "id_2").collect()}
    assert got == {p for p in all_pairs(rows, below) if p[0] % 7 == 0}


def test_few_blocks_meet_where_vectors_are_clustered(spark, monkeypatch):
    """The share of pairs of vectors whose blocks meet: under a tenth."""
    monkeypatch.setattr(P, "BLOCK_ROWS", 25)
    _, df = frame(spark, 2, 1500, 40, 0.01, hours=40)
    v = X.timed(df).withColumn("_b", F.lit(0).cast("long")).withColumn("_below", F.lit(0.05)).select("id", "t", "vector", "_below", "_b")
    centres = P.choose_pivots(v)
    placed = P.place(v, centres)
    share = P.visited_share(P.block_pairs(P.blocks(placed, centres, "_below"), P.blocks(placed, centres)))
    print(f"share of pairs visited: {share:.3f}")
    assert 0 < share < 0.1


def test_nearest_in_blocks(spark, monkeypatch):
    _, df = frame(spark, 3, 400, 5, 0.2, copies=30)
    near = lambda: sorted(map(tuple, X.knn_window(df, F.lit(0.3)).select("id", "other", "rank").collect()))
    whole = near()
    monkeypatch.setattr(P, "BLOCK_ROWS", 16)
    assert whole and near() == whole


def brute_farthest(rows):
    out = {}
    for k in {r[0] for r in rows}:
        v = np.array([r[2] for r in rows if r[0] == k and r[2] is not None and np.isfinite(r[2]).all() and np.linalg.norm(r[2]) > 0])
        n = sum(r[0] == k for r in rows)
        if n > 1:
            out[k] = None
        if n > 1 and len(v) > 1:
            v = v / np.linalg.norm(v, axis=1)[:, None]
            out[k] = round(float((1 - v @ v.T).max()), 6)
    return out


def stories(seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 16))
    rows = [("tight", (middle[0] + rng.normal(size=16) * 0.01).tolist()) for _ in range(300)]
    rows += [("parts", (middle[i % 6] + rng.normal(size=16) * 0.02).tolist()) for i in range(400)]
    rows += [("wide", rng.normal(size=16).tolist()) for _ in range(120)]
    rows += [("copies", middle[1].tolist())] * 150 + [("opposite", middle[2].tolist()), ("opposite", (-2 * middle[2]).tolist())] + [("opposite", (middle[3] * k).tolist()) for k in range(1, 60)]
    rows += [("two", middle[0].tolist()), ("two", middle[1].tolist()), ("one", middle[0].tolist()), ("zero", [0.0] * 16), ("zero", middle[0].tolist()), ("none", None), ("none", [float("nan")] * 16)]
    return [(k, i, v) for i, (k, v) in enumerate(rows)]


def test_farthest_pairs_equal_all_pairs(spark, monkeypatch):
    rows = stories()
    df = spark.createDataFrame(rows, "cluster_id string, id long, vector array<double>")
    far = lambda: {r[0]: None if r[1] is None else round(r[1], 6) + 0.0 for r in X.intra_max(df).collect()}
    want = {k: d if d is None else abs(d) for k, d in brute_farthest(rows).items()}
    assert want["zero"] is None and want["none"] is None and "one" not in want and want["opposite"] == 2 and want["copies"] == 0
    assert {k: d if d is None else abs(d) for k, d in far().items()} == want
    monkeypatch.setattr(X, "BLOCK_ROWS", 16)
    monkeypatch.setattr(P, "BLOCK_ROWS", 16)
    assert {k: d if d is None else abs(d) for k, d in far().items()} == want
    assert X.intra_max(df.limit(0)).count() == 0


def test_farthest_pair_visits_few_blocks(spark, monkeypatch):
    """Members of a core are dropped by their angle to the centroid; where parts lie around it, so that none
    can be dropped, few pairs of their blocks meet."""
    monkeypatch.setattr(P, "BLOCK_ROWS", 16)
    unit = lambda v: (np.array(v) / np.linalg.norm(v)).tolist()
    rows = [(k, i, unit(v)) for k, i, v in stories() if k == "parts"]
    core = [v for k, _, v in stories() if k == "tight"]
    rows += [("core", 5000 + i, unit(v)) for i, v in enumerate([*core, np.eye(16)[0], -np.eye(16)[0]])]
    placed, pairs = X.far_blocks(spark.createDataFrame(rows, "_b string, id long, vector array<double>"))
    left = {r["_b"]: r["count"] for r in placed.groupBy("_b").count().collect()}
    share = P.visited_share(pairs.where("_b = 'parts'"))
    print(f"members left: {left}; share of the parts' pairs visited: {share:.3f}")
    assert 2 <= left["core"] < 10 and left["parts"] == 400 and 0 < share < 0.1
