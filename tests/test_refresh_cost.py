"""The steps of a refresh over prices: each table and each name is worked on once."""

from datetime import datetime, timedelta

import __spark_entry__ as entry
import numpy as np
from pyspark.sql import functions as F

from lodestory.functions import scalars as S
from lodestory.operators import prices as P
from lodestory.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def test_a_provider_is_cleaned_once_a_row(spark):
    df = spark.createDataFrame([("Alibaba Cloud", "Qwen")], "p string, a string")
    fit = df.where(S.provider_matches_author(F.col("p"), F.col("a")))
    plan = fit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2 and fit.count() == 1


def test_a_refresh_makes_its_samples_once(spark, monkeypatch):
    made = {"price_samples": 0, "benchmarks": 0}
    for name in made:
        real = getattr(Fixtures, name)
        monkeypatch.setattr(Fixtures, name, lambda x, name=name, real=real: made.__setitem__(name, made[name] + 1) or real(x))
    df = entry.queries()["M23_run_cycle"](spark, SF)
    assert made == {"price_samples": 1, "benchmarks": 1} and df.count()


def test_prices_fold_apart_as_together(spark):
    rng = np.random.default_rng(4)
    pick = lambda *of: of[rng.integers(len(of))]
    names = [*P.FIELDS, *P.FLOOR_FACTS]
    rows = [(m, datetime(2024, 1, 1) + timedelta(days=k), *(pick(None, 0.0, 1.0, 1.02, 2.0, float("nan")) for _ in P.FIELDS), pick("p", "q", None), pick("fp8", None), pick(1.0, 2.0, None)) for m in range(40) for k in range(60)]
    want = []
    for m in range(40):
        stored, pending = {}, None
        for _, ts, *values in (r for r in rows if r[0] == m):
            events, stored, pending = P.step(stored, dict(zip(names, map(P._value, values), strict=True)), pending)
            want += [P.event_row(m, ts, e, stored) for e in events]
    schema = "model_id long, sample_ts timestamp, vendor_in double, vendor_out double, floor_in double, floor_out double, floor_provider string, floor_quant string, floor_context double"
    got = P.debounced_changes(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 200
