"""Rows move once for each group that they meet."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

import lodestory.operators.vectors as X
from lodestory.operators import meetings as M
from lodestory.operators import pivots as P


def test_copies_of_a_row_do_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 20)
    copies = []
    for n in (400, 2400):  # 20 and 120 blocks
        rows = spark.range(n).select("id", F.lit(0).cast("long").alias("_b"))
        met, meetings = M.dealt(rows, rows.select(*[F.col(c).alias(c) for c in rows.columns]))
        copies.append(met.count() / n)
        assert meetings == M.LEAST_GROUPS**2
    assert copies == [2 * M.LEAST_GROUPS] * 2


def test_strings_and_ties_keep_their_order(spark, monkeypatch):
    """Equal vectors, ids of letters, several batches: the nearest are those of the smallest ids."""
    rng = np.random.default_rng(0)
    kinds = rng.normal(size=(6, 8))
    rows = [(f"a{i:03d}", datetime(2024, 1, 1) + timedelta(minutes=i), kinds[i % 6].tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, published_at timestamp, vector array<double>")
    monkeypatch.setattr(P, "BLOCK_ROWS", 8)
    monkeypatch.setattr(M, "HELD", 50)
    got = {(r["id"], r["rank"]): r["other"] for r in X.knn_window(df, F.lit(0.01), k=3).collect()}
    want = {(i, k + 1): o for n, (i, _, _) in enumerate(rows) for k, o in enumerate([j for m, (j, _, _) in enumerate(rows) if m % 6 == n % 6 and m != n][:3])}
    assert got == want
