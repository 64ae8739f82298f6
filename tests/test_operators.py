import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestory.operators import prices as P
from lodestory.operators import registry as R
from lodestory.operators import vectors as X
from lodestory.operators.graph import connected_components
from lodestory.plans.registry import digest_moves, digest_teaser, legacy_free, wide
from lodestory.plans.vectors import cluster_eval
from lodestory.sources import sinks
from lodestory.sources.fixtures import Fixtures
from lodestory.storage import scratch

T0 = datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_percentiles(spark):
    rows = [("a", "x", 1.0), ("b", "x", 1.0), ("c", "x", 3.0), ("a", "y", 9.0)]
    got = {(r["model_id"], r["benchmark"]): r["pct"] for r in R.percentiles(spark.createDataFrame(rows, "model_id string, benchmark string, score double")).collect()}
    assert got == {("a", "x"): 0, ("b", "x"): 0, ("c", "x"): 100, ("a", "y"): 100}


def test_frontier_rises(spark):
    rows = [r["eci"] for r in R.running_max_frontier(wide(Fixtures(spark, SF)), "price_in", "eci", "id").orderBy("price_in", "id").collect()]
    assert rows and all(a < b for a, b in zip(rows, rows[1:], strict=False))


def test_debounce_rules():
    v = lambda a, b: {"vendor_in": a, "floor_in": b}
    ev, stored, pending = P.step({}, v(1.0, 2.0), None)
    assert (ev, stored, pending) == ([], v(1.0, 2.0), {})
    ev, stored, pending = P.step(stored, v(2.0, 2.0), pending)
    assert not ev and stored["vendor_in"] == 1.0 and pending == {"vendor_in": 2.0}
    ev, s2, p2 = P.step(stored, v(3.0, 2.0), pending)  # contradiction restarts
    assert not ev and p2 == {"vendor_in": 3.0}
    ev, s3, p3 = P.step(stored, v(1.0, 2.0), pending)  # revert clears
    assert not ev and p3 == {}
    ev, s4, p4 = P.step(stored, v(2.0, 2.0), pending)  # confirmed
    assert ev == [{"price_scope": "vendor", "old_value": 1.0, "new_value": 2.0}] and s4["vendor_in"] == 2.0
    ev, s5, p5 = P.step(s4, v(2.0, None), p4)  # a floor that vanishes keeps its value
    assert not ev and s5["floor_in"] == 2.0 and p5 == {}
    ev, s6, p6 = P.step({"vendor_in": None, "floor_in": 2.0}, v(5.0, 2.0), {"vendor_in": 5.0})  # from null: no event
    assert not ev and s6["vendor_in"] == 5.0


def test_debounced_is_independent_of_partitions(spark):
    s = Fixtures(spark, SF).price_samples()
    from lodestory.shipping import ship

    ship(spark)
    a = P.debounced_changes(s).toPandas().sort_values(["model_id", "sample_ts", "price_scope"]).reset_index(drop=True)
    b = P.debounced_changes(s.repartition(13)).toPandas().sort_values(["model_id", "sample_ts", "price_scope"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def vectors(spark, rows):
    data = [(i, T0 + timedelta(hours=h), s, c, v) for i, h, s, c, v in rows]
    return spark.createDataFrame(data, "id long, published_at timestamp, source_name string, cluster_id string, vector array<double>")


def at(distance):
    c = 1 - distance
    return [c, (1 - c * c) ** 0.5]


def test_merge_rules(spark):
    base = [(1, 0, "n", "a", [1.0, 0.0]), (2, 1, "n", "b", at(0.20)), (3, 100, "n", "c", [1.0, 0.0]), (4, 0, "arXiv", "p", [0.0, 1.0]), (5, 0, "arXiv", "r", [-0.6, 0.8])]
    p = X.story_points(vectors(spark, base), "arXiv")
    pairs = {(r["a"], r["b"]) for r in X.close_pairs(p, news=0.30, paper=0.10).collect()}
    assert pairs == {("a", "b")}  # near in time and meaning; not 100 h apart, not two papers
    merged = {r["old"]: r["new"] for r in X.merge_stories(p, X.close_pairs(p, news=0.30, paper=0.10)).collect()}
    assert merged["b"] == "a" and merged["c"] == "c"


def walk(rows, thr, hours=48, k=10):
    """The greedy rule over all rows at once."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    vec = {r[0]: np.array(r[4]) for r in rows}
    when = {r[0]: r[1] for r in rows}
    story, members = {}, {}
    for i, *_ in rows:
        d = {j: 1 - vec[i] @ vec[j] / np.linalg.norm(vec[i]) / np.linalg.norm(vec[j]) for j in vec if j != i and abs(when[i] - when[j]) <= hours}
        home = i
        for j in [j for _, j in sorted((x, j) for j, x in d.items() if x < thr)][:k]:
            if j in story:
                c = np.mean([vec[m] for m in members[story[j]]], 0)
                if 1 - c @ vec[i] / np.linalg.norm(c) / np.linalg.norm(vec[i]) < thr:
                    home = story[j]
                    break
        story[i] = home
        members.setdefault(home, []).append(i)
    return story


@pytest.mark.parametrize("seed", [0, 1])
def test_greedy_by_component_equals_the_whole(spark, seed):
    from lodestory.shipping import ship

    ship(spark)
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.integers(0, 200)), "n", None, (rng.normal(size=4) + 2 * np.eye(4)[i % 4]).tolist()) for i in range(80)]
    got = {r["id"]: r["story"] for r in X.greedy_cluster(vectors(spark, rows), F.lit(0.3)).collect()}
    assert got == walk(rows, 0.3)


def test_knn_join_is_no_nested_loop(spark):
    v = Fixtures(spark, SF).vectors()
    assert "NestedLoop" not in plan_of(X.knn_window(v, F.lit(0.6)))


def test_aliases_have_version_borders(spark):
    texts = spark.createDataFrame([(1, "gpt-5 is out"), (2, "gpt-5.6 sol is out"), (3, "kimi k2.5"), (4, "KIMI K2 now")], "id long, text string")
    alias = spark.createDataFrame([("gpt-5", 10), ("kimi k2", 20)], "alias string, model_id long")
    got = {(r["id"], r["model_id"]) for r in R.match_models(texts, alias, "id", "text").collect()}
    assert (1, 10) in got and (2, 10) not in got and (4, 20) in got and (3, 20) not in got


def test_alias_index(spark):
    m = spark.createDataFrame([(1, "Claude Fable 5"), (2, "Claude Haiku"), (3, "o1"), (4, "Fable 5")], "id long, name string")
    assert {(r["alias"], r["model_id"]) for r in R.alias_index(m).collect()} == {("claude fable 5", 1), ("fable 5", 1), ("claude haiku", 2)}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "f"), (2, "b", None)], "id long, name string, family string")
    new = spark.createDataFrame([(2, "B", "g"), (1, "A", None), (3, "c", None)], "id long, name string, family string")
    got = {tuple(r) for r in sinks.upsert(old, new, "id", overwrite=["name"], keep=["family"]).collect()}
    assert got == {(1, "A", "f"), (2, "B", "g"), (3, "c", None)}
    again = sinks.upsert(spark.createDataFrame(list(got), old.schema), new, "id", overwrite=["name"], keep=["family"])
    assert {tuple(r) for r in again.collect()} == got


def test_versioned_table(spark):
    t = sinks.VersionedTable(spark, scratch(spark))
    assert t.read() is None
    t.write(spark.range(2))
    t.write(spark.range(3))
    assert t.read().count() == 3 and len(t.versions()) == 2


def test_stream_debounce_equals_batch(spark):
    from lodestory.plans import all_queries

    q = all_queries()
    cols = ["model_id", "sample_ts", "price_scope", "old_value", "new_value"]
    a, b = (sorted(map(tuple, q[n](spark, SF).select(cols).collect())) for n in ("J4_debounced_changes", "K2_stream_debounced_prices"))
    assert a and a == b


def compose_moves(events, most):
    """The reference's choice, event by event: events are ranked."""
    models, types, out, rest = set(), set(), [], list(events)
    while len(out) < most:
        free = [e for e in rest if e["model_id"] not in models]
        if not free:
            break
        pick = next((e for e in free if e["event_type"] not in types), free[0])
        rest.remove(pick)
        models.add(pick["model_id"])
        types.add(pick["event_type"])
        out.append(pick)
    return out


def test_digest_prefers_new_types(spark):
    rows = [(k, k % 150, "price" if k < 150 else "benchmark" if k < 290 else "context", T0 - timedelta(minutes=k), 0 if k < 150 else 2 if k < 290 else 3) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, model_id long, event_type string, detected_at timestamp, rk int")
    ranked = sorted((r.asDict() for r in df.collect()), key=lambda e: (e["rk"], -e["detected_at"].timestamp(), e["id"]))
    for most in (1, 2, 3, 5):
        assert [r["id"] for r in digest_moves(df, most)] == [e["id"] for e in compose_moves(ranked, most)]
    assert [r["event_type"] for r in digest_moves(df, 3)] == ["price", "benchmark", "context"]
    assert len(digest_moves(df.where("model_id < 2"), 5)) == 2 and digest_moves(df.limit(0), 2) == []


@pytest.mark.parametrize("newest", [100, None])
def test_digest_teaser(spark, newest):
    x = Fixtures(spark, SF)
    ids = {r["id"]: r for r in x.models().collect()}
    since = datetime(2024, 1, 24)
    week = [e.asDict() for e in legacy_free(x.model_events()).withColumn("at", F.unix_micros("detected_at")).where(F.col("detected_at") >= F.lit(since.isoformat()).cast("timestamp")).collect() if e["model_id"] in ids]
    week = sorted(week, key=lambda e: (-e["at"], e["id"]))[:newest]

    def fine(e):
        small = e["event_type"] == "price" and e["price_scope"] == "floor"
        return not small or (e["new_num"] is not None and e["old_num"] > 0 and abs((e["new_num"] - e["old_num"]) / e["old_num"] * 100) >= 15)

    def rank(e):
        return (0 if e["price_scope"] == "vendor" else 1) if e["event_type"] == "price" else {"benchmark": 2, "context": 3, "catalog": 4}.get(e["event_type"], 5)

    ranked = sorted(filter(fine, week), key=lambda e: (rank(e), -e["at"], e["id"]))
    for rows in (3, 6):
        got = digest_teaser(x, rows, story_days=31, newest=newest).orderBy("pos").collect()
        want = compose_moves([e for e in ranked if e["event_type"] != "catalog"], rows - 1)
        events = [r["key"] for r in got if r["kind"] == "event"]
        assert events[: len(want)] == [str(e["id"]) for e in want] and len(got) == rows
        assert got[-1]["kind"] == "story" and [r["pos"] for r in got] == [*range(1, rows + 1)]
    # no moves: the fact, then one line for the catalog, then stories
    class Quiet(Fixtures):
        def model_events(self):
            return super().model_events().where("event_type = 'catalog'")

    got = digest_teaser(Quiet(spark, SF), 6, story_days=31, newest=newest).orderBy("pos").collect()
    catalog = [e for e in ranked if e["event_type"] == "catalog"]
    n = {}
    for e in catalog:
        n.setdefault(ids[e["model_id"]]["vendor"], []).append(e)
    vendor, group = max(n.items(), key=lambda g: len(g[1]))
    lines = [r for r in got if r["href"] == "/models/changes"]
    if newest is None:
        assert len(lines) == 1 and lines[0]["key"] == str(group[0]["id"]) and (len(group) == 1 or lines[0]["text"] == f"{len(group)} new {vendor} models in the tracker")
    assert [r["kind"] for r in got] == sorted(r["kind"] for r in got) and got[-1]["kind"] == "story"


def test_cluster_eval_parts(spark):
    x = Fixtures(spark, SF)
    cut_off = datetime(2024, 1, 17)
    c = {r["id"]: r for r in x.clusters().withColumn("t", F.col("first_published_at").cast("string")).collect() if r["t"] >= str(cut_off)}
    a = [r for r in x.articles().select("cluster_id", "impact", "title").collect() if r["cluster_id"] in c]
    got = {}
    for r in cluster_eval(x).collect():
        got.setdefault(r["part"], {})[r["key"]] = (r["value"], r["text"])
    assert c and len(c) < x.clusters().count()
    assert {k: v[0] for k, v in got["total"].items()} == {"stories": len(c), "articles": len(a)}
    assert sum(v[0] for v in got["score"].values()) == len(c) and sum(v[0] for v in got["impact"].values()) == len(a)
    assert got["impact"].get("none", (0,))[0] == sum(r["impact"] is None for r in a)
    rate = lambda lo, hi: sum(lo <= r["significance_score"] < hi for r in c.values()) / len(c)
    assert got["tier"]["high"][0] == pytest.approx(rate(8.5, 99)) and got["tier"]["notable"][0] == pytest.approx(rate(7, 8.5))
    several = {k for k, r in c.items() if r["article_count"] > 1}
    assert len(got["label"]) == min(100, len(c)) and (len(several) > 100 or several <= set(got["label"]))
    for k, (_, text) in got["label"].items():
        assert text.count(" || ") >= c[k]["article_count"] and text.startswith(c[k]["headline"])
    assert all(set(k.split("|")) <= set(c) for k in got.get("missed merge", {})) and set(got.get("false merge", {})) <= set(c)
