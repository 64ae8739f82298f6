"""One component of articles needs few searches for components."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

import lodestory.operators.slots as S
import lodestory.operators.vectors as X


def test_one_component_is_searched_seldom(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), (np.eye(6)[0] * 2 + rng.normal(size=6) * 0.3).tolist(), None) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, published_at timestamp, vector array<double>, story string")
    whole = {r["id"]: r["story"] for r in X.assign_stories(frame, F.lit(0.4)).collect()}
    searched, binned = [], S._binned
    monkeypatch.setattr(S, "GROUP_ROWS", 20)
    monkeypatch.setattr(S, "SLOT_GROUPS", 4)
    monkeypatch.setattr(S, "_binned", lambda slot, near, size: searched.append(size > 20) or binned(slot, near, size))
    assert {r["id"]: r["story"] for r in X.assign_stories(frame, F.lit(0.4)).collect()} == whole
    assert sum(searched) <= 4 < len(searched)
