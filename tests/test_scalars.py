import pytest
from pyspark.sql import functions as F

from lodestory.functions import scalars as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [(10.0, 5), (33.0, 8), (90.0, 10), (0.0, 1), (-3.0, 1), (10000.0, 10)])
def test_normalize_score(spark, raw, want):
    assert one(spark, S.normalize_score(F.col("r")), r=raw) == want


@pytest.mark.parametrize("name,want", [("gpt-5_high", "gpt5"), ("Model 2025-01-31", "model"), ("A.B c", "abc")])
def test_normalize_key(spark, name, want):
    assert one(spark, S.normalize_key(F.col("n")), n=name) == want


@pytest.mark.parametrize("raw,want", [("3e12", "3T"), ("70000000000", "70B"), ("1500000", "1.5M"), ("0", None), ("x", None)])
def test_format_parameters(spark, raw, want):
    assert one(spark, S.format_parameters(F.col("r")), r=raw) == want


@pytest.mark.parametrize("text,want", [("One done. Two is cut...", "One done."), ("no sentence…", "no sentence…"), ("Whole text.", "Whole text."), ("  ", None)])
def test_clean_description(spark, text, want):
    assert one(spark, S.clean_description(F.col("t")), t=text) == want


@pytest.mark.parametrize("p,a,want", [("Z.AI", "z-ai", True), ("Moonshot AI", "moonshotai", True), ("Alibaba Cloud", "qwen", True), ("Reseller", "openai", False), ("", "openai", False)])
def test_provider_matches_author(spark, p, a, want):
    assert one(spark, S.provider_matches_author(F.col("p"), F.col("a")), p=p, a=a) is want


@pytest.mark.parametrize("title,want", [("We propose a dataset", "research-papers"), ("New GPU chip", "hardware-infrastructure"), ("Hello", "uncategorized")])
def test_categorize(spark, title, want):
    assert one(spark, S.categorize(F.col("t"), F.lit(None).cast("string")), t=title) == want


def test_noise_is_substring(spark):
    assert one(spark, S.is_noise(F.col("t")), t="Netflix does things") is True


@pytest.mark.parametrize("title,want", [("AI news", True), ("email paid in Taiwan", False), ("An LLM", True)])
def test_relevance(spark, title, want):
    assert one(spark, S.is_relevant(F.col("t"), F.lit(None).cast("string")), t=title) is want


@pytest.mark.parametrize("tag,name,want", [("b1234", "x", True), ("v1.2", "v1.2", False), ("abcdef1", "", True), ("main", "main", True), ("release", "other", False)])
def test_rolling_build(spark, tag, name, want):
    assert one(spark, S.is_rolling_build(F.col("t"), F.col("n")), t=tag, n=name) is want


@pytest.mark.parametrize("old,new,kind,delta,tone", [("10", "7", "price", "-30.0%", "good"), ("10", "12", "price", "+20.0%", "bad"), ("10", "12", "benchmark", "+20.0%", "good"), ("x", "2", "price", None, "neutral"), ("5", "5", "price", None, "neutral")])
def test_delta_and_tone(spark, old, new, kind, delta, tone):
    assert one(spark, S.event_delta(F.col("o"), F.col("n")), o=old, n=new) == delta
    assert one(spark, S.event_tone(F.lit(kind), F.col("o"), F.col("n")), o=old, n=new) == tone


def test_truncate_words(spark):
    assert one(spark, S.truncate_words(F.col("t"), 2), t="a b  c") == "a b…"
    assert one(spark, S.truncate_words(F.col("t"), 3), t="a b  c") == "a b  c"


def test_valid_date(spark):
    assert one(spark, S.valid_date(F.col("t")), t="2024-02-29") is True
    assert one(spark, S.valid_date(F.col("t")), t="2024-99-99") is False


def test_cosine_distance_of_nothing_is_null(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(S.cosine_distance(F.col("a"), F.col("b")).alias("d")).first()["d"] is None
