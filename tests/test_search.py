"""Search over headlines against a plain version."""

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestory.operators import search as S
from lodestory.plans import all_queries

NOW = datetime(2024, 2, 1)


def plain(stories, articles, query, *, category=None, date_from=None, date_to=None, synonyms=None, limit=20, offset=0):
    names = S.expanded(query, synonyms)
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    lo = datetime.fromisoformat(date_from) if date_from else datetime.min
    hi = datetime.fromisoformat(date_to) + timedelta(days=1) - timedelta(milliseconds=1) if date_to else datetime.max

    def has(headline, phrase):
        w, p = cut(headline), list(phrase)
        return any(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))

    wanted = S.alternatives(query) if len(names) == 1 else [[(tuple(cut(n)), True)] for n in names]
    fit = [s for s in stories if (category is None or s["category"] == category) and lo <= s["first_published_at"] <= hi]
    order = lambda s: (-s["significance_score"], -s["first_published_at"].timestamp(), s["id"])
    first = sorted((s for s in fit if any(all(has(s["headline"], p) == yes for p, yes in a) for a in wanted)), key=order)[:100]
    named = [a for a in articles if a["cluster_id"] and any(n.lower() in a["source_name"].lower() for n in names) and lo <= a["published_at"] <= hi]
    fresh = {a["cluster_id"] for a in sorted(named, key=lambda a: (-a["published_at"].timestamp(), a["id"]))[:500]}
    second = sorted((s for s in fit if s["id"] in fresh and s not in first), key=order)[:100]
    ranked = sorted((-round(s["significance_score"] / (1 + (NOW - s["first_published_at"]).total_seconds() / 86400 / 60), 6), s["id"]) for s in first + second)
    return [(k + 1, i, -r) for k, (r, i) in enumerate(ranked[offset : offset + limit])], bool(first), bool(second)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    words = ["Open", "model", "the", "la", "new-model", "v2.1", "Änderung", "of", "big"]
    stories = [{"id": f"s{i:03}", "headline": None if i == 7 else " ".join(rng.choice(words, 6)), "category": "ab"[i % 2], "significance_score": float(rng.integers(1, 11)), "first_published_at": datetime(2024, 1, 1) + timedelta(hours=int(rng.integers(0, 600)))} for i in range(300)]
    articles = [{"id": i, "cluster_id": None if i % 9 == 0 else f"s{i % 300:03}", "title": f"t{i}", "source_name": f"Outlet{i % 11}", "published_at": datetime(2024, 1, 1) + timedelta(minutes=int(rng.integers(0, 36000))), "authority": int(rng.integers(1, 9))} for i in range(900)]
    s = spark.createDataFrame([tuple(r.values()) for r in stories], "id string, headline string, category string, significance_score double, first_published_at timestamp")
    a = spark.createDataFrame([tuple(r.values()) for r in articles], "id long, cluster_id string, title string, source_name string, published_at timestamp, authority int")
    return stories, articles, s, a, S.write_postings(s)


@pytest.mark.parametrize(
    "asked",
    [
        {"query": "open MODEL"}, {"query": '"the model" OR "model la"', "category": "a"}, {"query": "-the -of"}, {"query": "big -open", "date_from": "2024-01-05", "date_to": "2024-01-09"}, {"query": "new model", "offset": 5, "limit": 50},
        {"query": "outlet3", "date_from": "2024-01-10"}, {"query": " V2 ", "synonyms": {"v2": ["Outlet1", "open model"]}, "category": "b"}, {"query": "nothing"}, {"query": "änderung 1"}, {"query": '"" -- or'},
    ],
)
def test_pages_equal_the_plain_version(data, asked):
    stories, articles, s, a, index = data
    want, _, _ = plain(stories, articles, **asked)
    page = S.search_page(s, a, index, now=F.lit(f"{NOW}").cast("timestamp"), **asked)
    assert sorted((r["pos"], r["id"], r["rank_score"]) for r in page.collect()) == want
    members = {}
    for r in sorted((r for r in articles if r["cluster_id"]), key=lambda r: (-r["authority"], r["published_at"], r["id"])):
        members.setdefault(r["cluster_id"], []).append(r["id"])
    assert all([m["id"] for m in r["articles"]] == members[r["id"]][:3] for r in page.collect())


def test_both_branches_are_met(data):
    stories, articles, *_ = data
    assert plain(stories, articles, "open")[1:] == (True, False) and plain(stories, articles, "outlet3")[1:] == (False, True)
    assert plain(stories, articles, "v2", synonyms={"v2": ["outlet1"]})[1:] == (True, True)


def test_query_words():
    assert S.alternatives('a "b c" or -d e') == [[(("a",), True), (("b", "c"), True)], [(("d",), False), (("e",), True)]]
    assert S.alternatives("meta-ai z.ai") == [[(("meta", "ai"), True), (("z", "ai"), True)]]
    assert S.expanded("OpenAI ") == ["OpenAI ", "gpt", "dall-e", "sora", "codex", "whisper"]


def test_refused(data):
    _, _, s, a, index = data
    now = F.lit(f"{NOW}").cast("timestamp")
    for bad in ("", "x" * 201, "50%", "a_b"):
        with pytest.raises(ValueError, match="a query has"):
            S.search_page(s, a, index, bad, now=now)
    with pytest.raises(ValueError, match="a page has"):
        S.search_page(s, a, index, "a", now=now, limit=51)


def test_index_is_read_by_token(data):
    plan = S.matching(data[-1], S.alternatives("open model"))._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [model,open])" in plan


def test_query_meets_both_branches(spark):
    got = {r["search"] for r in all_queries()["M6_search"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {"words", "outlet", "alternatives", "synonyms"}
