"""Scalar rules as column expressions: pure, native, inlined by Catalyst."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestory.functions import vocabulary as V


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Substring test of many words; null text holds none."""
    return F.coalesce(any_of([text.contains(w) for w in words]), F.lit(False))


def half_up(x: Column) -> Column:
    """floor(x + 0.5), as browsers round."""
    return F.floor(x + 0.5)


def normalize_score(raw: Column) -> Column:
    """Log-compressed 1..10 score; 1 for nothing; halves go to even."""
    s = F.bround(2.4 * F.log1p(raw / 1.43), 0)
    return F.when(raw <= 0, 1.0).otherwise(F.least(F.greatest(s, F.lit(1.0)), F.lit(10.0)))


def effective_threshold(source: Column, *, paper_prefix: str = V.PAPER_PREFIX, news: float = V.NEWS_THRESHOLD, paper: float = V.PAPER_THRESHOLD) -> Column:
    return F.when(source.startswith(paper_prefix), paper).otherwise(news)


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a norm is under 1e-9."""
    n = norm(a) * norm(b)
    return F.when((norm(a) >= 1e-9) & (norm(b) >= 1e-9), 1 - dot(a, b) / n)


def categorize(title: Column, body: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """First category with a keyword in the title, else in the body, else uncategorized."""
    keywords = keywords or V.CATEGORY_KEYWORDS

    def first(text: Column) -> Column:
        return F.coalesce(*[F.when(contains_any(F.lower(text), w), F.lit(c)) for c, w in keywords.items()])

    return F.coalesce(first(title), first(body), F.lit(V.UNCATEGORIZED))


def is_relevant(title: Column, body: Column, keywords: Sequence[str] = V.RELEVANCE_KEYWORDS, word: str = "ai") -> Column:
    text = F.lower(F.concat(title, F.lit(" "), F.coalesce(body, F.lit(""))))
    return text.rlike(rf"\b{word}\b") | contains_any(text, keywords)


def is_noise(title: Column, patterns: Sequence[str] = V.NOISE_PATTERNS) -> Column:
    return contains_any(F.lower(title), patterns)


def strip_html(html: Column) -> Column:
    """Text of tags removed and common entities decoded, white space collapsed; script text stays."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncate_words(text: Column, most: int = 150) -> Column:
    """More words than `most`: the first ones and an ellipsis; otherwise the string as it is."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > most, F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("…"))).otherwise(text)


def normalize_key(name: Column) -> Column:
    """Lower-case letters and digits without effort suffix and embedded date."""
    text = F.regexp_replace(F.coalesce(name, F.lit("")), r"_[A-Za-z0-9]+$", "")
    text = F.regexp_replace(text, r"\d{4}-\d{2}-\d{2}", "")
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]", "")


def slugify(name: Column, *, most: int | None = None, empty: str = "model") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    if most:
        s = F.regexp_replace(F.substring(s, 1, most), r"-+$", "")
    return F.when(s == "", F.lit(empty)).otherwise(s)


def derive_family(name: Column, families: Sequence[tuple[str, str]] = V.FAMILIES) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]", "")
    return F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in families])


def trim_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_parameters(raw: Column) -> Column:
    """3e12 as 3T, 70e9 as 70B; null for nothing positive."""
    x = raw.try_cast("double")

    def unit(size: float, sign: str) -> Column:
        return F.concat(trim_zeros(F.format_string("%.1f", x / size)), F.lit(sign))

    return F.when(x >= 1e12, unit(1e12, "T")).when(x >= 1e9, unit(1e9, "B")).when(x >= 1e6, unit(1e6, "M")).when(x > 0, trim_zeros(F.format_string("%.0f", x)))


def coerce_tristate(raw: Column) -> Column:
    v = F.lower(F.trim(raw))
    return F.when(v.isin("yes", "true", "1"), True).when(v.isin("no", "false", "0"), False)


def tristate_access(access: Column) -> Column:
    a = F.lower(F.trim(access))
    return F.when(a.contains("open weight"), True).when(a.contains("api access") | a.contains("hosted") | a.contains("unreleased"), False)


def clean_description(text: Column) -> Column:
    """Text cut off by an ellipsis ends at its last whole sentence."""
    t = F.trim(text)
    body = F.regexp_replace(t, r"[.… ]+$", "")
    whole = F.regexp_extract(body, r"(?s)^(.*[.!?]) ", 1)
    cut = F.when(whole != "", whole).when(body != "", F.concat(body, F.lit("…")))
    return F.when(t == "", None).when(t.endswith("..") | t.endswith("…"), cut).otherwise(t)


def price_per_million(raw: Column) -> Column:
    x = F.round(raw.try_cast("double") * 1e6, 4)
    return F.when(raw.try_cast("double") > 0, x)


def alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]", "")


def provider_matches_author(provider: Column, author: Column, aliases: dict[str, str] = V.VENDOR_ALIASES) -> Column:
    """Equal, or one begins with the other, after aliases; both need three letters or digits."""

    def fit(names: Column) -> Column:
        p, a = names["p"], names["a"]
        for k, v in aliases.items():
            a = F.when(a == k, F.lit(v)).otherwise(a)
        return (F.length(p) >= 3) & (F.length(a) >= 3) & (p.startswith(a) | a.startswith(p))

    # a list of one, so that each name is cleaned once a row
    return F.exists(F.array(F.struct(alnum(provider).alias("p"), alnum(author).alias("a"))), fit)


def split_vendor_name(name: Column) -> tuple[Column, Column]:
    parts = F.split(name, ": ", 2)
    return F.when(F.size(parts) > 1, F.trim(parts[0])), F.trim(F.element_at(parts, -1))


def catalog_key(ident: Column) -> Column:
    last = F.element_at(F.split(ident, "/"), -1)
    return normalize_key(F.regexp_replace(last, r":(free|extended|beta|thinking|online|nitro|floor)$", ""))


def strip_parens(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"\s*\([^)]*\)", "")


def strip_publisher(title: Column, publisher: Column) -> Column:
    tail = F.concat(F.lit(" - "), publisher)
    return F.when(F.endswith(title, tail), F.substring(title, F.lit(1), F.length(title) - F.length(tail))).otherwise(title)


def publisher_matches(publisher: Column, org: Column) -> Column:
    p, o = F.lower(publisher), F.lower(org)
    return F.contains(p, o) | F.contains(o, p)


def is_rolling_build(tag: Column, name: Column) -> Column:
    t = F.trim(tag)
    return F.when(t.contains("."), False).otherwise(t.rlike(r"^[a-f0-9]{5,}$") | t.rlike(r"^b\d+$") | F.coalesce(F.trim(name) == t, F.lit(False)))


def clean_release_body(body: Column) -> Column:
    """Release notes without what is no prose; null if nothing is left."""
    for pattern, instead in V.RELEASE_NOISE:
        body = F.regexp_replace(body, pattern, instead)
    return F.when(body != "", body)


def to_utc_timestamp_any(raw: Column) -> Column:
    """Epoch seconds, ISO with offset, naive ISO (UTC) or the form of feeds (Tue, 02 Jan 2024 10:00:00 GMT);
    null if unreadable."""
    number = F.when(raw.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(raw.try_cast("double")))
    mail = F.regexp_replace(F.regexp_replace(raw, r"^\s*[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC|UT|Z)\s*$", " +0000")
    return F.coalesce(number, raw.try_cast("timestamp"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def within_window(raw: Column, as_of: str, days: int) -> Column:
    d = F.substring(raw, 1, 10).try_cast("date")
    return F.coalesce(d >= F.date_sub(F.lit(as_of).cast("date"), days), F.lit(False))


def valid_date(raw: Column) -> Column:
    """Both the shape and a real day."""
    return F.coalesce(raw.rlike(r"^\d{4}-\d{2}-\d{2}$") & (raw.try_cast("date").cast("string") == raw), F.lit(False))


def event_rank(kind: Column, scope: Column) -> Column:
    return F.when((kind == "price") & F.coalesce(scope == "vendor", F.lit(False)), 0).when(kind == "price", 1).when(kind == "benchmark", 2).when(kind == "context", 3).when(kind == "catalog", 4).otherwise(5)


def relative_pct(old: Column, new: Column) -> Column:
    o, n = old.try_cast("double"), new.try_cast("double")
    return F.when((o > 0) & (n >= 0), (n - o) / o * 100)


def event_delta(old: Column, new: Column) -> Column:
    pct = relative_pct(old, new)
    return F.when(pct != 0, F.format_string("%+.1f%%", pct))


def event_tone(kind: Column, old: Column, new: Column) -> Column:
    pct = relative_pct(old, new)
    good = F.when(kind == "price", pct < 0).when(kind.isin("benchmark", "context"), pct > 0)
    return F.when(pct.isNull() | (pct == 0) | good.isNull(), "neutral").when(good, "good").otherwise("bad")


def is_material(kind: Column, scope: Column, old: Column, new: Column, pct: float = V.FLOOR_MATERIAL_PCT) -> Column:
    o, n = old.try_cast("double"), new.try_cast("double")
    big = F.coalesce((o > 0) & (F.abs((n - o) / o * 100) >= pct), F.lit(False))
    return F.when((kind == "price") & F.coalesce(scope == "floor", F.lit(False)), big).otherwise(True)


def tier(x: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """Name of the first cut that x reaches, else the last name."""
    out = F.when(x >= cuts[0], names[0])
    for c, n in zip(cuts[1:], names[1:-1], strict=True):
        out = out.when(x >= c, n)
    return out.when(x.isNotNull(), names[-1])


def blended_price(price_in: Column, price_out: Column) -> Column:
    p = (price_in + price_out) / 2
    return F.when(p > 0, p)


def discount_pct(floor: Column, listed: Column) -> Column:
    return F.when(listed > 0, (1 - floor / listed) * 100)


def format_context(tokens: Column) -> Column:
    return F.when(tokens >= 1_000_000, F.format_string("%.1fM", tokens / 1e6)).when(tokens >= 1000, F.format_string("%dK", F.floor(tokens / 1000 + 0.5).cast("long"))).when(tokens > 0, tokens.cast("string"))


def format_score(score: Column, unit: Column) -> Column:
    return F.when(unit == "%", F.format_string("%.1f%%", score * 100)).when((unit == "min") & (score >= 60), F.format_string("%.1fh", score / 60)).when(unit == "min", F.format_string("%dm", F.floor(score + 0.5).cast("long"))).otherwise(F.floor(score + 0.5).cast("long").cast("string"))


def norm_vendor(vendor: Column) -> Column:
    s = F.lower(F.coalesce(vendor, F.lit("")))
    return F.when(s.contains("google") | s.contains("deepmind"), "google").when(s.contains("zhipu") | s.contains("z.ai"), "zai").otherwise(F.element_at(F.split(s, r"[\s(]"), 1))


def expand_synonyms(query: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """The query and, if the whole of it is known, its synonyms."""
    q, out = F.lower(F.trim(query)), F.array(query)
    for k, v in (synonyms or V.SYNONYMS).items():
        out = F.when(q == k, F.concat(F.array(query), F.array(*map(F.lit, v)))).otherwise(out)
    return out


def is_english(text: Column, lang: Column, least: int = 10) -> Column:
    """Short texts pass; longer ones unless another language was detected."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return (words < least) | F.coalesce(lang == "en", F.lit(True))


def clean_summary(text: Column, most: int = 90) -> Column:
    t = F.trim(F.regexp_replace(F.trim(text), r"^`+|`+$", ""))
    t = F.regexp_replace(t, r"(?i)^(summary|tl;?dr)\s*[:\-]\s*", "")
    words = F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(words, 1, most), " "), r"[,;:]+$", ""), F.lit("…"))
    return F.coalesce(F.when(F.size(words) > most, cut).otherwise(F.array_join(words, " ")), F.lit(""))


def word_hit(text: Column, alias: str) -> Column:
    """An alias between version borders: gpt-5 is not in gpt-5.6."""
    import re

    return text.rlike(rf"(?<![a-z0-9]){re.escape(alias)}(?![a-z0-9.\-])")


#: Inlined SQL functions: name(arguments) and body, for use from SQL text.
SQL_FUNCTIONS = {
    "norm_score(raw DOUBLE)": "CASE WHEN raw <= 0 THEN 1D ELSE least(greatest(bround(2.4 * log1p(raw / 1.43), 0), 1D), 10D) END",
    "slug_of(name STRING)": "coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '-'), '^-+|-+$', ''), ''), 'model')",
    "key_of(name STRING)": "regexp_replace(lower(regexp_replace(regexp_replace(coalesce(name, ''), '_[A-Za-z0-9]+$', ''), '[0-9]{4}-[0-9]{2}-[0-9]{2}', '')), '[^a-z0-9]', '')",
    "discount(floor DOUBLE, listed DOUBLE)": "CASE WHEN listed > 0 THEN (1 - floor / listed) * 100 END",
}


def register_sql_functions(spark) -> None:
    for signature, body in SQL_FUNCTIONS.items():
        kind = "STRING" if "STRING" in signature else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
