"""Prefix scans against plain loops, with groups that lie in several parts."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestory.operators import scan as C
from lodestory.plans import all_queries


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        g = "hot" if i < 1200 else None if i < 1300 else f"g{i % 150:03}"  # one group of well over a third
        rows.append((g, float(rng.integers(0, 4) if i % 2 else rng.integers(0, 500)), i, int(rng.integers(0, 1000)) if i % 50 else None))
    rows += [("lone", 1.0, 5000, 1), ("flat", 2.0, 6000, 1), *[("flat", 2.0, 6001 + k, k) for k in range(700)]]
    return rows, spark.createDataFrame(rows, "g string, v double, id long, y long")


@pytest.fixture(autouse=True)
def many_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def groups(rows, keyed=True):
    out = {}
    for r in rows:
        out.setdefault(r[0] if keyed else None, []).append(r)
    return out


def test_groups_lie_in_several_parts(data):
    rows = C.spread(data[1], ["g"], ["v", "id"])
    counts = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count_distinct("_p").alias("n")).collect()}
    assert counts["hot"] > 3 and counts["flat"] > 1
    assert rows.groupBy("_p").count().agg(F.max("count")).first()[0] < 700


@pytest.mark.parametrize("keyed", [True, False])
def test_rank_shares(data, keyed):
    rows, df = data
    got = {r["id"]: (r["below"], r["size"]) for r in C.rank_shares(df, ["g"] if keyed else [], "v", "id").collect()}
    for own in groups(rows, keyed).values():
        values = np.sort([r[1] for r in own])
        for r in own:
            assert got[r[2]] == (int(np.searchsorted(values, r[1])), len(own))


@pytest.mark.parametrize("keyed", [True, False])
def test_running_max_and_beside(data, keyed):
    rows, df = data
    keys = ["g"] if keyed else []
    top = {r["id"]: r["before"] for r in C.running_max(df, keys, ["v", "id"], "y").collect()}
    near = {r["id"]: (r["previous"], r["next"]) for r in C.beside(df, keys, ["v", "id"], "y").collect()}
    for own in groups(rows, keyed).values():
        own = sorted(own, key=lambda r: (r[1], r[2]))
        most = None
        for k, r in enumerate(own):
            assert top[r[2]] == most
            assert near[r[2]] == (own[k - 1][3] if k else None, own[k + 1][3] if k + 1 < len(own) else None)
            if r[3] is not None:
                most = r[3] if most is None else max(most, r[3])


def test_nothing(spark):
    none = spark.createDataFrame([], "g string, v double, id long, y long")
    assert not C.rank_shares(none, ["g"], "v", "id").collect() and not C.running_max(none, [], ["v"], "y").collect() and not C.beside(none, ["g"], ["v"], "y").collect()


@pytest.mark.parametrize("name", ["E2_win_percentile_rank", "E5_win_running_max_frontier", "E6_win_group_frontier", "E7_win_gap_detect", "M18_substantive_days"])
def test_no_window_over_a_whole_group(spark, name):
    plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    for specs in re.findall(r"Window \[.*?\], \[([^\]]*)\]", plan):
        assert specs.startswith("_p#"), specs
