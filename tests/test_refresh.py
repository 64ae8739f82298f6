"""Queries without a SQL twin against plain versions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestory.operators import prices as P
from lodestory.operators import vectors as X
from lodestory.plans import all_queries
from lodestory.plans.vectors import recluster_recent, recluster_report, run_cycle
from lodestory.sources import sinks
from lodestory.sources.fixtures import NEWS, PAPER, PAPER_PREFIX, Fixtures
from lodestory.storage import cut, scratch
from lodestory.streaming import streams as R

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def x(spark):
    return Fixtures(spark, SF)


def plain_stories(rows, fixed, hours=48, k=10):
    """The greedy rule over all rows (id, micros, source, vector) whose id has no fixed story."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    ids = [r[0] for r in rows]
    t = np.array([r[1] for r in rows])
    v = np.array([r[3] for r in rows], float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    story, members = dict(fixed), {}
    for i, s in fixed.items():
        members.setdefault(s, []).append(ids.index(i))
    for n, (i, at, source, _) in enumerate(rows):
        if i in fixed:
            continue
        thr = PAPER if source.startswith(PAPER_PREFIX) else NEWS
        d = 1 - u @ u[n]
        near = [j for j in range(len(rows)) if j != n and abs(t[j] - at) <= hours * 3_600_000_000 and d[j] < thr]
        home, tried = str(i), set()
        for j in sorted(near, key=lambda j: (round(d[j], 12), ids[j]))[:k]:
            s = story.get(ids[j])
            if s is None or s in tried:
                continue
            tried.add(s)
            c = v[members[s]].mean(0)
            if 1 - c @ v[n] / np.linalg.norm(c) / np.linalg.norm(v[n]) < thr:
                home = s
                break
        story[i] = home
        members.setdefault(home, []).append(n)
    return story


def rows_of(vectors):
    got = vectors.withColumn("t", F.unix_micros("published_at")).collect()
    return [(r["id"], r["t"], r["source_name"], r["vector"]) for r in got], {r["id"]: r["cluster_id"] for r in got}, {r["id"]: r["published_at"] for r in got}


def test_recluster_recent(x):
    v = x.vectors()
    rows, old, at = rows_of(v)
    now = datetime(2024, 1, 5)
    got = {}
    for r in recluster_recent(x.articles(), v, F.lit("2024-01-05").cast("timestamp"), 48).collect():
        got.setdefault(r["part"], {})[r["key"]] = (r["text"], r["value"])
    inside = {i for i, t in at.items() if t >= now - timedelta(hours=48)}
    fixed = {i: s for i, s in old.items() if s is not None and i not in inside}
    want = plain_stories(rows, fixed)
    assert {int(i): s[0] for i, s in got["kept"].items()} == fixed
    assert {int(i): s[0] for i, s in got["assigned"].items()} == {i: s for i, s in want.items() if i not in fixed}
    assert inside and set(got["assigned"].values()) != set()
    all_old = {r["id"]: (r["cluster_id"], r["published_at"]) for r in x.articles().collect()}
    touched = {c for c, t in all_old.values() if c is not None and t >= now - timedelta(hours=48)}
    left = {c for c, t in all_old.values() if c is not None and t < now - timedelta(hours=48)}
    assert set(got["dropped"]) == touched - left and set(got.get("rescored", {})) == touched & left


def test_recluster_report(x):
    v = x.vectors()
    rows, old, _ = rows_of(v)
    new = plain_stories(rows, {})
    frame = cut(x.spark.createDataFrame(list(new.items()), "id long, story string"))
    got = {}
    for r in recluster_report(x.articles(), v, frame).collect():
        got.setdefault(r["part"], {})[r["key"]] = r["value"]
    parts = {}
    for i, s in old.items():
        if s is not None:
            parts.setdefault(s, set()).add(new[i])
    assert got["split"] == {s: len(p) for s, p in parts.items()}
    sizes = {}
    for i, s in new.items():
        sizes.setdefault(s, []).append(i)
    source = {r[0]: r[2] for r in rows}
    vec = {r[0]: np.array(r[3], float) / np.linalg.norm(r[3]) for r in rows}
    several = [m for m in sizes.values() if len(m) > 1]
    assert got["total"]["articles"] == len(new) and got["total"]["stories"] == len(sizes) and got["total"]["several"] == len(several)
    assert got["total"]["papers"] == sum(sum(source[i].startswith(PAPER_PREFIX) for i in m) >= 2 for m in several)
    spread = lambda m: max(1 - vec[a] @ vec[b] for a in m for b in m if a < b)
    limit = lambda m: max(0.20, min(PAPER if source[i].startswith(PAPER_PREFIX) else NEWS for i in m))
    assert got["total"]["suspects"] == sum(spread(m) > limit(m) for m in several)
    assert sum(got["score"].values()) == len(sizes)
    again = {r["id"]: r["story"] for r in X.greedy_cluster(v, F.when(F.col("source_name").startswith(PAPER_PREFIX), PAPER).otherwise(NEWS)).collect()}
    assert {i: str(s) for i, s in again.items()} == new
    assert {r["part"] for r in all_queries()["I9_recluster_compare"](x.spark, SF).collect()} == {"split", "total", "score"}


def test_blocks_change_nothing(spark, x, monkeypatch):
    v = x.vectors()
    near = lambda: sorted(map(tuple, X.knn_window(v, F.lit(0.6)).select("id", "other", "rank").collect()))
    wide = lambda: sorted(map(tuple, X.intra_max(v).collect()))
    a, b = near(), wide()
    monkeypatch.setattr(X, "BLOCK_ROWS", 7)
    monkeypatch.setattr(X.pivots, "BLOCK_ROWS", 7)
    assert a and near() == a and wide() == b


def test_judged_pairs_merge(spark):
    points = spark.createDataFrame([("a", 1, 3), ("b", 2, 1), ("c", 3, 2), ("d", 4, 9)], "id string, t long, size long")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    verdicts = spark.createDataFrame([("b", "c", True), ("c", "d", False)], "a string, b string, same boolean")
    close = spark.createDataFrame([], "a string, b string")
    got = {r["old"]: r["new"] for r in X.merge_with_verdicts(points, close, pairs, verdicts).collect()}
    assert got == {"a": "a", "b": "c", "c": "c", "d": "d"}
    got = {r["old"]: r["new"] for r in X.merge_with_verdicts(points, pairs.where("a = 'a'"), pairs, verdicts).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_floor_facts_move_with_a_confirmed_floor():
    at = lambda price, who, out=4.0: {"floor_in": price, "floor_out": out, "floor_provider": who}
    _, stored, pending = P.step({}, at(2.0, "p"), None)
    assert stored == at(2.0, "p")
    ev, stored, pending = P.step(stored, at(1.0, "q"), pending)
    assert not ev and stored["floor_provider"] == "p"
    ev, stored, pending = P.step(stored, at(1.0, "r"), pending)
    assert ev == [{"price_scope": "floor", "old_value": 2.0, "new_value": 1.0}] and stored == at(1.0, "r")
    ev, stored, pending = P.step(stored, at(1.0, "s", 3.0), pending)
    ev, stored, pending = P.step(stored, at(1.0, "s", 3.0), pending)
    assert ev == [{"price_scope": "floor", "old_value": 4.0, "new_value": 3.0, "direction": "output"}] and stored["floor_provider"] == "s"
    ev, stored, pending = P.step(stored, at(None, "t", None), pending)
    assert not ev and stored == at(1.0, "s", 3.0) and not pending


def test_debounce_against_plain_folds(x):
    by = {}
    for r in sorted(x.price_samples().collect(), key=lambda r: (r["model_id"], r["sample_ts"])):
        by.setdefault(r["model_id"], []).append(r)
    want = []
    for m, rows in by.items():
        stored, pending = {}, None
        for r in rows:
            fresh = {c: r[c] for c in (*P.FIELDS, *P.FLOOR_FACTS)}
            ev, stored, pending = P.step(stored, fresh, pending)
            want += [(m, r["sample_ts"], e["price_scope"], e.get("direction", "input"), e["old_value"], e["new_value"], stored["floor_provider"] if e["price_scope"] == "floor" else None) for e in ev]
    q = all_queries()
    for name in ("J4_debounced_changes", "K2_stream_debounced_prices"):
        got = [tuple(r)[:7] for r in q[name](x.spark, SF).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[3] for w in want} == {"input", "output"} and any(w[6] for w in want)


def test_daily_gate(x):
    by = {}
    for r in x.events().select("user_id", "ts").collect():
        by.setdefault(r["user_id"], []).append(r["ts"])
    want = []
    for u, times in by.items():
        last = None
        for t in sorted(times):
            if last is None or t - last >= timedelta(hours=20):
                last = t
                want.append((u, t))
    got = [tuple(r) for r in all_queries()["K3_stream_daily_gate"](x.spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) < sum(map(len, by.values()))


def test_label_sheet(x):
    rows = all_queries()["A22_export_label_sheet"](x.spark, SF).collect()
    c = {r["id"]: r for r in x.clusters().collect()}
    titles = {}
    for a in x.articles().orderBy("id").collect():
        titles.setdefault(a["cluster_id"], []).append(a["title"])
    many = {k for k, r in c.items() if r["article_count"] >= 2}
    assert len(rows) == min(100, len(c)) and {r["id"] for r in rows} >= (many if len(many) <= 100 else set())
    for r in rows:
        assert r["member_titles"] == " || ".join(titles[r["id"]]) and r["headline"] == c[r["id"]]["headline"]
        assert (r["id"] in many) or len(many) < 100


def test_run_cycle(x):
    got = {}
    for r in run_cycle(x, most=20).collect():
        got.setdefault(r["part"], {})[r["key"]] = r["value"]
    arts = {r["id"]: r for r in x.articles().collect()}
    stored = [a for i, a in arts.items() if i % 4]
    urls = {a["source_url"] for a in stored}
    since = datetime(2024, 1, 31) - timedelta(days=7)
    named = {(a["source_name"].lower(), a["title"].lower()) for a in stored if a["published_at"] >= since}
    first, seen = {}, set()
    for i in sorted(i for i in arts if i % 4 == 0):
        first.setdefault(arts[i]["source_url"], arts[i])
    fresh = []
    for a in sorted(first.values(), key=lambda a: a["id"]):
        key = (a["source_name"], a["title"].lower())
        if key not in seen:
            seen.add(key)
            if a["source_url"] not in urls and (a["source_name"].lower(), a["title"].lower()) not in named:
                fresh.append(a["id"])
    assert got["run"]["articles ingested"] == min(20, len(fresh)) and got["run"]["deferred"] == max(0, len(fresh) - 20)
    assert got["run"]["clusters updated"] > 0 and got["story"] and sum(got["roster"].values()) == x.models().count()
    events = all_queries()["J4_debounced_changes"](x.spark, SF).count()
    assert len(got["price event"]) == events and got["registry"]["price moves"] > 0


# streams


def test_every_replay_has_several_batches(spark, x):
    from lodestory.plans.streams import replay

    seen = []
    R.run_batches(replay(x, x.events().select("event_id", "ts"), "ts"), lambda b, k: seen.append((k, b.count(), b.agg(F.min("ts"), F.max("ts")).first())), "append")
    full = [s for s in seen if s[1]]
    assert len(full) == 4 and sum(n for _, n, _ in full) == x.events().count()
    assert all(a[2][1] < b[2][0] for a, b in zip(full, full[1:], strict=False))


def test_dedup_forgets_behind_the_watermark(spark):
    path = scratch(spark)
    for day, ids in ((1, [1, 2]), (2, [1]), (20, [3]), (21, [4]), (22, [1]), (23, [1])):
        spark.createDataFrame([(i, T0 + timedelta(days=day)) for i in ids], "id long, at timestamp").coalesce(1).write.mode("append").parquet(path)
    got = R.run_to_end(R.dedup(R.read_stream(spark, path, files=1), ["id"], "at", 7)).collect()
    # the second batch repeats the first; the third moves the watermark past both and the fourth
    # drops their state, so 1 is new again in the fifth and known in the sixth
    assert sorted((r["id"], r["at"].day) for r in got) == [(1, 2), (1, 23), (2, 2), (3, 21), (4, 22)]


def test_late_rows_go_to_the_backfill(x):
    got = {r["id"]: r["late"] for r in all_queries()["K9_stream_late_backfill"](x.spark, SF).collect()}
    assert 0 < sum(got.values()) < len(got) == x.articles().count()


def test_upsert_batches_merge_and_repeat_nothing(spark):
    path, table = scratch(spark), scratch(spark)
    for rows in ([(1, 1, "a"), (2, 2, "b")], [(1, 3, "c")], [(3, 4, "d"), (1, 5, "e")]):
        spark.createDataFrame(rows, "key long, seq long, v string").coalesce(1).write.mode("append").parquet(path)
    t = R.upsert_batches(R.read_stream(spark, path, files=1), table, "key", order="seq", overwrite=["v"], keep=["seq"])
    assert {r["key"]: r["v"] for r in t.read().collect()} == {1: "e", 2: "b", 3: "d"} and len(t.versions()) >= 3
    again = R.upsert_batches(R.read_stream(spark, path, files=1), table, "key", order="seq", overwrite=["v"], keep=["seq"])
    assert len(again.versions()) == len(t.versions()) and {r["v"] for r in again.read().collect()} == {"e", "b", "d"}


def test_two_writers_do_not_hide_each_other(spark):
    path = scratch(spark)
    a, b = sinks.VersionedTable(spark, path), sinks.VersionedTable(spark, path)
    a.read(), b.read()
    a.write(spark.range(1))
    with pytest.raises(Exception, match="(?i)exists"):
        b.write(spark.range(2))
    b.read()
    b.write(spark.range(2))
    assert a.read().count() == 2
