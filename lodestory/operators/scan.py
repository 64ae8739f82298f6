"""Prefix scans over sorted groups of any size: rank shares, running maxima, the rows beside a row.

Rows are sorted in ranges over (group, order), so a large group lies in several parts. Each part is
summed up for itself. A border between two parts lies within one group at most, so what parts hand on is
one summary each: those (one or two a part) are folded on the driver and joined back by
broadcast. Then every part is finished alone: no window ever spans a whole group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lodestory.storage import cut


def spread(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows in ranges of (keys, order), written with the number of their part, `_p`, which rises in that order."""
    cols = [*keys, *order]
    return cut(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_p", F.spark_partition_id()))


def _ends(groups: DataFrame, keys: list[str]) -> list[Row]:
    """Of each part the summaries of its first and its last group, and how many groups it has."""
    whole, key = F.struct(*groups.columns), F.struct(*keys) if keys else F.struct(F.lit(0))
    return sorted(groups.groupBy("_p").agg(F.min_by(whole, key).alias("first"), F.max_by(whole, key).alias("last"), F.count("*").alias("n")).collect(), key=lambda r: r["_p"])


def _carry(ends: list[Row], keys: list[str], start: Callable, merge: Callable, *, back: bool = False) -> dict[tuple, tuple]:
    """(part, key): what the parts before (back: after) hand on to its group, where one does."""
    out, held_key, held = {}, None, None
    for r in reversed(ends) if back else ends:
        near, far = (r["last"], r["first"]) if back else (r["first"], r["last"])
        key = tuple(near[k] for k in keys)
        if held is not None and key == held_key:
            out[(r["_p"], *key)] = held
            held = merge(held, near)
        else:
            held = start(near)
        if r["n"] > 1:
            key, held = tuple(far[k] for k in keys), start(far)
        held_key = key
    return out


def _with_carry(rows: DataFrame, keys: list[str], carry: dict[tuple, tuple], columns: dict[str, str]) -> DataFrame:
    """Adds what is handed on (null where nothing is); at most one row a part."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(["_cp int", *(f"_c{i} {kinds[k]}" for i, k in enumerate(keys)), *(f"{c} {t}" for c, t in columns.items())])
    small = F.broadcast(rows.sparkSession.createDataFrame([(*at, *v) for at, v in carry.items()], schema))
    on = F.col("_p") == F.col("_cp")
    for i, k in enumerate(keys):
        on &= rows[k].eqNullSafe(F.col(f"_c{i}"))
    return rows.join(small, on, "left").drop("_cp", *[f"_c{i}" for i in range(len(keys))])


def rank_shares(df: DataFrame, keys: list[str], value: str, ident: str) -> DataFrame:
    """Adds `below`, the number of rows of the group with a smaller value, and `size`, its rows. Equal values
    share a place, also where they lie in several parts."""
    rows = spread(df, keys, [value, ident])
    runs = rows.groupBy("_p", *keys, F.col(value).alias("_v")).agg(F.count("*").alias("_m"))
    groups = runs.groupBy("_p", *keys).agg(F.sum("_m").alias("m"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.max_by("_m", "_v").alias("top"))
    ends = _ends(groups, keys)
    start = lambda s: (s["m"], s["high"], s["m"] - s["top"])  # rows so far, the last value, and where its run began

    def merge(held, s):
        n, last, began = held
        if s["low"] == s["high"]:
            return n + s["m"], s["high"], began if s["low"] == last else n
        return n + s["m"], s["high"], n + s["m"] - s["top"]

    before = _carry(ends, keys, start, merge)
    after = _carry(ends, keys, lambda s: (s["m"],), lambda held, s: (held[0] + s["m"],), back=True)
    carry = {at: (*before.get(at, (0, None, None)), *after.get(at, (0,))) for at in before | after}
    kind = dict(rows.dtypes)[value]
    out = _with_carry(rows, keys, carry, {"_n": "long", "_last": kind, "_began": "long", "_rest": "long"})
    part = Window.partitionBy("_p", *keys)
    zero = F.lit(0).cast("long")
    out = out.withColumn("_local", F.rank().over(part.orderBy(value)) - 1).withColumn("_size", F.count("*").over(part))
    below = F.when(F.col("_began").isNotNull() & F.col(value).eqNullSafe(F.col("_last")), F.col("_began")).otherwise(F.coalesce("_n", zero) + F.col("_local"))
    return out.withColumn("below", below).withColumn("size", F.coalesce("_n", zero) + F.col("_size") + F.coalesce("_rest", zero)).drop("_p", "_n", "_last", "_began", "_rest", "_local", "_size")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds `before`, the largest value of the rows before in the group (null for the first)."""
    rows = spread(df, keys, order)
    ends = _ends(rows.groupBy("_p", *keys).agg(F.max(value).alias("top")), keys)
    most = lambda a, b: b if a is None else a if b is None else max(a, b)
    carry = _carry(ends, keys, lambda s: (s["top"],), lambda held, s: (most(held[0], s["top"]),))
    out = _with_carry(rows, keys, carry, {"_before": dict(rows.dtypes)[value]})
    line = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("before", F.greatest("_before", F.max(value).over(line))).drop("_p", "_before")


def beside(df: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Adds `previous` and `next`: the column's value in the row before and after (null at the ends)."""
    rows = spread(df, keys, order)
    at = F.struct(*order)
    ends = _ends(rows.groupBy("_p", *keys).agg(F.min_by(column, at).alias("head"), F.max_by(column, at).alias("tail")), keys)
    before = _carry(ends, keys, lambda s: (s["tail"],), lambda held, s: (s["tail"],))
    after = _carry(ends, keys, lambda s: (s["head"],), lambda held, s: (s["head"],), back=True)
    kind = dict(rows.dtypes)[column]
    carry = {k: (*before.get(k, (None,)), *after.get(k, (None,))) for k in before | after}
    out = _with_carry(rows, keys, carry, {"_prev": kind, "_next": kind})
    part = Window.partitionBy("_p", *keys)
    line = part.orderBy(*order)
    place, size = F.row_number().over(line), F.count("*").over(part)
    previous = F.when(place == 1, F.col("_prev")).otherwise(F.lag(column).over(line))
    following = F.when(place == size, F.col("_next")).otherwise(F.lead(column).over(line))
    return out.withColumn("previous", previous).withColumn("next", following).drop("_p", "_prev", "_next")


def share(below: Column, size: Column) -> Column:
    """Percent rank from rank_shares; null for a lone row."""
    return F.when(size > 1, below / (size - 1))
