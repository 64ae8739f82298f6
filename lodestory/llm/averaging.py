"""Parameter averaging: every task trains a copy of a model on its own rows, and what the copies changed is averaged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a parameter that are averaged in one group.
BLOCK = 512
_ARROW = pa.schema([("part", pa.int32()), ("name", pa.string()), ("block", pa.int32()), ("rows", pa.int64()), ("moved", pa.binary()), ("change", pa.binary())])
SCHEMA = "part int, name string, block int, rows long, moved binary, change binary"


def changes(part: int, rows: int, before: dict[str, np.ndarray], after: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What a task that trained on so many rows changed, by parameter and block; only rows that moved."""
    for name, old in before.items():
        d = (after[name] - old).astype("<f4").reshape(len(old), -1)
        for k, lo in enumerate(range(0, len(d), BLOCK)):
            moved = d[lo : lo + BLOCK].any(1)
            if moved.any():
                row = {"part": part, "name": name, "block": k, "rows": rows, "moved": moved.tobytes(), "change": d[lo : lo + BLOCK][moved].tobytes()}
                yield pa.RecordBatch.from_pylist([row], _ARROW)


def _mean(df: pd.DataFrame) -> pd.DataFrame:
    """The mean of one block; a row's over the tasks that moved it, by their rows. In order of the tasks, as sums round."""
    df = df.sort_values("part")
    moved = [np.frombuffer(m, bool) for m in df["moved"]]
    weight, total = np.zeros(len(moved[0])), None
    for n, at, change in zip(df["rows"], moved, df["change"], strict=True):
        d = np.frombuffer(change, "<f4").reshape(int(at.sum()), -1)
        total = np.zeros((len(at), d.shape[1])) if total is None else total
        total[at] += n * d
        weight[at] += n
    mean = total / np.maximum(weight, 1)[:, None]
    return pd.DataFrame({"name": df["name"].iloc[:1], "block": df["block"].iloc[:1], "change": [mean.astype("<f4").tobytes()]})


def averaged(changed: DataFrame, before: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The parameters after the tasks' changes; the driver gets one mean change of the model's size."""
    out = {name: old.copy() for name, old in before.items()}
    for r in changed.groupBy("name", "block").applyInPandas(_mean, "name string, block int, change binary").collect():
        rows = out[r["name"]][r["block"] * BLOCK : (r["block"] + 1) * BLOCK]
        rows += np.frombuffer(r["change"], "<f4").reshape(rows.shape)
    return out
