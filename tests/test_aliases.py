"""Aliases in texts, by one automaton, against a test of every alias in every text."""

import re

import numpy as np

import lodestory.operators.aliases as A
from lodestory.plans import all_queries
from lodestory.shipping import ship


def plain(texts, aliases):
    out = set()
    for i, text in texts:
        if text is None:
            continue
        low = re.sub(r"\s+", " ", text.lower()).strip(" ")
        run = re.sub(r"[^a-z0-9]", "", text.lower())
        for alias, model in aliases:
            tight = re.sub(r"[^a-z0-9]", "", alias)
            if not tight:
                continue
            if re.search(rf"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9.\-])", low) or len(tight) >= 5 and re.search(rf"{tight}(?![0-9])", run):
                out.add((i, model))
    return out


TEXTS = [
    (1, "Model 4 is out"), (2, "model 4.1 is out"), (3, "model 4-mini"), (4, "the MODEL  4\n"), (5, "model4 and more"), (6, "supermodel 4"), (7, None), (8, ""), (9, "model 41"), (10, "a.i. (beta) x"), (11, "C++ new"), (12, "model 4"), (12, "model 4"), (13, "Mo-del-4!"), (14, "ab ab-c abc"), (15, "x" * 100_000 + " ab"),
]
ALIASES = [("model 4", 40), ("model 4", 41), ("model", 1), ("model 4.1", 2), ("a.i.", 3), ("(beta)", 4), ("c++", 5), ("ab", 6), ("ab-c", 7), ("...", 8), ("model 41", 9)]


def found(spark, texts, aliases):
    t = spark.createDataFrame(texts, "id long, text string")
    return {(r["id"], r["model_id"]) for r in A.match_aliases(t, spark.createDataFrame(aliases, "alias string, model_id long"), "id", "text").collect()}


def test_borders_and_blocks(spark, monkeypatch):
    ship(spark)
    want = plain(TEXTS, ALIASES)
    assert (1, 40) in want and (2, 40) not in want and (9, 40) not in want and (6, 1) not in want and (13, 41) in want
    assert found(spark, TEXTS, ALIASES) == want
    monkeypatch.setattr(A, "BLOCK_LETTERS", 9)  # several automata
    assert found(spark, TEXTS, ALIASES) == want


def test_random_texts(spark):
    rng = np.random.default_rng(2)
    signs = list("ab1 .-")
    texts = [(i, "".join(rng.choice(signs, 60))) for i in range(200)]
    aliases = [("".join(rng.choice(signs, int(rng.integers(1, 7)))), int(k)) for k in range(150)]
    aliases = [(re.sub(r"\s+", " ", a).strip() or "a", k) for a, k in aliases]
    assert found(spark, texts, aliases) == plain(texts, aliases)


def test_nothing(spark):
    assert not found(spark, [(1, "a")], []) and not found(spark, [], ALIASES)


def test_texts_are_not_moved(spark):
    plan = all_queries()["J12_match_models"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert "Exchange" in after and "low" not in after and "run" not in after  # only pairs are made distinct
