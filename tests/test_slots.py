"""The greedy rule settled slot by slot equals the rule over all rows at once."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import lodestory.operators.slots as S
import lodestory.operators.vectors as X
from lodestory.operators.graph import connected_components
from lodestory.sources.fixtures import NEWS, Fixtures
from tests.test_refresh import plain_stories, rows_of

SF = "/root/testdata/sf0.001"


def plain(rows, fixed, thr):
    """As plain_stories, with one threshold and sums taken in order."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    ids, t, v = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    story, sums = dict(fixed), {}
    for n, i in enumerate(ids):
        if i in fixed:
            sums[fixed[i]] = sums.get(fixed[i], 0) + v[n]
    for n, i in enumerate(ids):
        if i in fixed:
            continue
        d = 1 - u @ u[n]
        near = [j for j in range(len(ids)) if j != n and abs(t[j] - t[n]) <= 48 * 3_600_000_000 and d[j] < thr]
        home, tried = str(i), set()
        for j in sorted(near, key=lambda j: (d[j], ids[j]))[:10]:
            s = story.get(ids[j])
            if s is None or s in tried:
                continue
            tried.add(s)
            if 1 - sums[s] @ v[n] / np.linalg.norm(sums[s]) / np.linalg.norm(v[n]) < thr:
                home = s
                break
        story[i] = home
        sums[home] = sums[home] + v[n] if home in sums else v[n]
    return story


def guarded(limit):
    """The replay, which fails on a group of more articles."""
    from lodestory.operators.slots import replay

    def f(df):
        assert df["id"].notna().sum() <= limit
        return replay(df)

    return f


@pytest.mark.parametrize(("seed", "fixed_share"), [(0, 0), (1, 0.3)])
def test_slots_equal_the_whole(spark, monkeypatch, seed, fixed_share):
    rng = np.random.default_rng(seed)
    zero = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        hot = i % 2 == 0  # half of all rows hang together, in one hour and around one centre
        at = 100 + float(rng.integers(0, 60)) / 60 if hot else float(rng.integers(0, 400))
        v = rng.normal(size=6) * (0.3 if hot else 1) + (np.eye(6)[0] * 2 if hot else np.eye(6)[int(rng.integers(0, 6))] * 2)
        rows.append((i, zero + timedelta(hours=at), v.tolist(), f"old{i % 7}" if rng.random() < fixed_share else None))
    frame = spark.createDataFrame(rows, "id long, published_at timestamp, vector array<double>, story string")
    micros = {r["id"]: r["t"] for r in frame.select("id", F.unix_micros("published_at").alias("t")).collect()}
    want = plain([(i, micros[i], v) for i, _, v, _ in rows], {r[0]: r[3] for r in rows if r[3]}, 0.4)
    near = X.knn_window(frame, F.lit(0.4)).select("id", "other")
    sizes = connected_components(near, "id", "other").groupBy("label").count().agg(F.max("count")).first()[0]
    assert sizes >= len(rows) / 2  # one component holds half of all rows
    monkeypatch.setattr(S, "GROUP_ROWS", 32)
    monkeypatch.setattr(S, "SLOT_GROUPS", 3)
    monkeypatch.setattr(S, "replay", guarded(32))
    got = {r["id"]: r["story"] for r in X.assign_stories(frame, F.lit(0.4)).collect()}
    assert got == {i: s for i, s in want.items() if rows[i][3] is None}


def test_slots_of_the_test_data(spark, monkeypatch):
    v = Fixtures(spark, SF).vectors()
    rows, _, _ = rows_of(v)
    want = plain_stories(rows, {})
    thr = F.when(F.col("source_name").startswith("src1"), 0.55).otherwise(NEWS)
    monkeypatch.setattr(S, "GROUP_ROWS", 50)
    monkeypatch.setattr(S, "SLOT_GROUPS", 2)
    got = {r["id"]: str(r["story"]) for r in X.greedy_cluster(v, thr).collect()}
    assert got == want


def test_nothing_to_assign(spark):
    none = spark.createDataFrame([], "id long, published_at timestamp, vector array<double>, story string")
    assert not X.assign_stories(none, F.lit(0.5)).collect()
    one = spark.createDataFrame([(5, datetime(2024, 1, 1), [1.0, 0.0], None), (6, datetime(2024, 1, 1), [0.0, 0.0], None)], none.schema)
    assert {r["id"]: r["story"] for r in X.assign_stories(one, F.lit(0.5)).collect()} == {5: "5", 6: "6"}
