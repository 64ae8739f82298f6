"""Models learn from every row, not from a sample of them."""

import numpy as np
from pyspark.sql import functions as F

import lodestory.llm.toxicity as T
from lodestory.llm.averaging import BLOCK, SCHEMA, averaged, changes
from lodestory.llm.language_id import START_ROWS, identify_language, split_rows, train_language_model
from lodestory.llm.shared import held_out
from tests.llm.test_operators import docs


def test_changes_are_averaged_over_the_tasks_that_made_them(spark):
    rng = np.random.default_rng(0)
    before = {"emb": rng.normal(0, 1, (BLOCK + 3, 2)).astype(np.float32), "base": np.zeros(1, np.float32)}
    steps = [{k: np.zeros_like(v) for k, v in before.items()} for _ in range(3)]
    steps[0]["emb"][0], steps[1]["emb"][0] = 1, 4
    steps[1]["emb"][BLOCK + 2] = 2
    steps[2]["base"][:] = 6
    rows = [r for part, (n, d) in enumerate(zip((1, 2, 5), steps, strict=True)) for b in changes(part, n, before, {k: before[k] + d[k] for k in before}) for r in b.to_pylist()]
    got = averaged(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), before)
    want = {k: v.copy() for k, v in before.items()}
    want["emb"][0] += 3  # (1 * 1 + 2 * 4) / 3
    want["emb"][BLOCK + 2] += 2
    want["base"] += 6
    assert all(np.allclose(got[k], want[k], atol=1e-5) for k in before)


def spoken(rng, letters):
    return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(12))


def test_language_learns_from_rows_beyond_the_start(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "x", ("aa", "bb")[k % 2]) for k in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trained, kept, _ = split_rows(df.where(~held_out("doc_id")), "doc_id", "lang", START_ROWS)
    assert trained.count() + kept.count() == df.where(~held_out("doc_id")).count()  # no row is left out
    start = {r[0] for r in trained.where("_start").select("doc_id").collect()}
    assert len(start) < 2000
    # half of the rows that the start doesn't see are written in letters that it never meets: eight groups a language
    first = {"aa": "abcdefg", "bb": "nopqrst"}
    later = {lang: ["".join(chr(0x400 + 5 * (2 * g + i) + j) for j in range(5)) for g in range(8)] for i, lang in enumerate(first)}
    texts = [(k, spoken(rng, later[lang][k // 4 % 8] if k not in start and k % 4 < 2 else first[lang]), lang) for k, _, lang in rows]
    m = train_language_model(spark.createDataFrame(texts, df.schema))
    new = [(2 * g + i, spoken(rng, later[lang][g])) for g in range(8) for i, lang in enumerate(first)]
    got = identify_language(docs(spark, new), m).select("doc_id", "lang_pred").collect()
    assert [r["lang_pred"] for r in got if r["lang_pred"] != ("aa", "bb")[r["doc_id"] % 2]] == []


def test_toxicity_learns_from_rows_beyond_the_start(spark, monkeypatch):
    monkeypatch.setattr(T, "START_TOXIC", 60)
    monkeypatch.setattr(T, "START_CLEAN", 120)
    rng = np.random.default_rng(2)
    n = 4000
    toxic = {k: int(k % 4 == 0) for k in range(n)}
    ids = spark.range(n).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 30)).alias("draw"))
    start = {r[0] for r in ids.where(F.col("draw") < 0.1 * (1 << 30)).collect()}  # the start and more
    calm, vile = [f"calm{k}" for k in range(60)], [f"{c}vile" for c in "abcdefghij"]
    say = lambda bad: " ".join([*rng.choice(calm, 8), *([bad] if bad else []), *rng.choice(calm, 4)])
    texts = [(k, say(("worst" if k in start else vile[k // 4 % 10]) if toxic[k] else None)) for k in range(n)]
    m = T.train_toxicity_model(docs(spark, texts), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"), None)
    got = T.score_toxicity(docs(spark, [(k, say(v)) for k, v in enumerate([*vile, *[None] * 30])]), m).select("doc_id", "predicted").collect()
    assert sum(r["predicted"] for r in got if r["doc_id"] < 10) >= 9 and sum(r["predicted"] for r in got if r["doc_id"] >= 10) <= 1
