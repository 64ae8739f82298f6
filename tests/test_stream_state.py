"""State that leaves the store, and late rows that meet those of their own time."""

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestory.operators import prices as P
from lodestory.operators.vectors import knn_window
from lodestory.shipping import ship
from lodestory.storage import scratch
from lodestory.streaming import streams as R

ZERO = datetime(2024, 1, 1)


def landed(spark, rows, schema, parts):
    """Rows as a stream of one file after another."""
    path = scratch(spark)
    for part in parts:
        spark.createDataFrame([r for r in rows if part(r)], schema).coalesce(1).write.mode("append").parquet(path)
    return R.read_stream(spark, path, files=1)


def keys_in_store(spark, out):
    store = spark.read.format("statestore").load(f"{out}/state")
    return {tuple(r["key"])[0] for r in store.collect()}


def test_gate_forgets_and_answers_alike(spark):
    ship(spark)
    rows = [(1, ZERO), (1, ZERO + timedelta(hours=19)), (2, ZERO + timedelta(hours=30)), (3, ZERO + timedelta(hours=200)), (1, ZERO + timedelta(hours=201)), (3, ZERO + timedelta(hours=210)), (3, ZERO + timedelta(hours=221))]
    parts = [lambda r: r[1] < ZERO + timedelta(hours=100), lambda r: r[1] >= ZERO + timedelta(hours=100)]
    out = scratch(spark)
    got = R.run_to_end(R.gated(landed(spark, rows, "k long, at timestamp", parts), "k", "at"), out=out)
    last, want = {}, set()
    for k, t in rows:
        if k not in last or t - last[k] >= timedelta(hours=20):
            last[k] = t
            want.add((k, t))
    assert {(r["key"], r["at"]) for r in got.collect()} == want
    assert keys_in_store(spark, out) <= {1, 3}  # key 2 had its last row far behind the watermark


def test_models_unseen_for_long_leave_the_store(spark):
    ship(spark)
    day = lambda k: ZERO + timedelta(days=k)
    rows = [(1, day(0), 1.0), (1, day(1), 2.0), (1, day(2), 2.0), (2, day(0), 1.0), (2, day(1), 4.0), (3, day(60), 1.0), (3, day(61), 9.0), (3, day(62), 9.0), (1, day(61), 7.0), (1, day(62), 3.0), (1, day(63), 3.0)]
    parts = [lambda r: r[1] < day(30), lambda r: r[1] >= day(30)]
    stream = lambda: landed(spark, rows, "model_id long, sample_ts timestamp, vendor_in double", parts)
    out = scratch(spark)
    events = R.run_to_end(R.debounced(stream(), forget_days=20), out=out)
    # model 1 was forgotten: 7.0 is its first sample again
    assert {(r["model_id"], r["sample_ts"], r["old_value"], r["new_value"]) for r in events.collect()} == {(1, day(2), 1.0, 2.0), (3, day(62), 1.0, 9.0), (1, day(63), 7.0, 3.0)}
    assert keys_in_store(spark, out) == {1, 3}
    # nobody is away for long: as the fold over all samples
    whole = R.run_to_end(R.debounced(stream(), forget_days=400))
    batch = P.debounced_changes(spark.createDataFrame(rows, "model_id long, sample_ts timestamp, vendor_in double"))
    pick = lambda df: {(r["model_id"], r["sample_ts"], r["old_value"], r["new_value"]) for r in df.collect()}
    assert pick(whole) == pick(batch) and len(pick(whole)) == 3


@pytest.fixture(scope="module")
def articles():
    rng = np.random.default_rng(6)
    return [(i, ZERO + timedelta(hours=float(rng.integers(0, 500))), (np.eye(5)[i % 5] * 2 + rng.normal(size=5)).tolist() if i % 13 else None) for i in range(240)]


def test_late_rows_meet_their_contemporaries(spark, articles):
    schema = "id long, published_at timestamp, vector array<double>"
    batch_of = {i: i * 37 % 101 // 26 for i, _, _ in articles}
    stream = landed(spark, articles, schema, [lambda r, k=k: batch_of[r[0]] == k for k in range(4)])
    rows, near = R.late_backfill(stream, scratch(spark), F.lit(0.3))
    newest, want_late = {}, set()
    for k in range(4):
        before = max((t for i, t, _ in articles if batch_of[i] < k), default=None)
        want_late |= {i for i, t, _ in articles if batch_of[i] == k and before is not None and t < before - timedelta(hours=48)}
    assert {r["id"] for r in rows.where("late").collect()} == want_late and rows.count() == len(articles)
    got = {(r["id"], r["other"], r["rank"]) for r in near.collect()}
    # the batch answer among what had landed by then
    want = set()
    df = spark.createDataFrame(articles, schema).where("vector is not null")
    for k in range(1, 4):
        late = [i for i in want_late if batch_of[i] == k]
        there = [i for i in batch_of if batch_of[i] <= k]
        want |= {(r["id"], r["other"], r["rank"]) for r in knn_window(df.where(F.col("id").isin(late)), F.lit(0.3), among=df.where(F.col("id").isin(there))).collect()}
    assert got == want and len({g[0] for g in got}) > 50


def test_only_partitions_of_late_times_are_read(spark, articles):
    path = scratch(spark)
    stream = landed(spark, articles, "id long, published_at timestamp, vector array<double>", [lambda r: r[0] < 200, lambda r: r[0] >= 200])
    R.late_backfill(stream, path, F.lit(0.3))
    stored = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/*")
    assert {"batch", "bucket"} <= set(stored.columns)
    plan = stored.where(F.col("bucket").isin([9862]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_debounce_of_models_that_share_a_group(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(R, "BLOCKS", 2)
    rng = np.random.default_rng(8)
    rows = [(m, ZERO + timedelta(days=k), float(rng.integers(1, 4))) for m in range(30) for k in range(20)]
    schema = "model_id long, sample_ts timestamp, vendor_in double"
    out = scratch(spark)
    stream = landed(spark, rows, schema, [lambda r: r[1] < ZERO + timedelta(days=9), lambda r: r[1] >= ZERO + timedelta(days=9)])
    got = R.run_to_end(R.debounced(stream, forget_days=400), out=out)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, P.debounced_changes(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert keys_in_store(spark, out) == {0, 1} and got.count() > 50


def test_a_replayed_part_lands_as_several_files(spark, monkeypatch):
    from lodestory.plans import streams as Q
    from lodestory.sources.fixtures import Fixtures

    monkeypatch.setattr(Q, "FILE_ROWS", 10)
    seen = []
    rows = spark.range(101).withColumn("at", F.when(F.col("id") < 97, F.col("id")).otherwise(F.col("id") * 10))
    stream = Q.replay(Fixtures(spark, ""), rows, "at", cuts=[50, 96, 97, 980])
    R.run_batches(stream, lambda b, k: seen.append((b.count(), b.agg(F.min("at"), F.max("at")).first(), b.select(F.input_file_name()).distinct().count())), "append")
    # parts of one row and of none too are batches of their own
    assert [(n, tuple(span)) for n, span, _ in seen] == [(51, (0, 50)), (46, (51, 96)), (0, (None, None)), (2, (970, 980)), (2, (990, 1000))]
    assert seen[0][2] == 3
