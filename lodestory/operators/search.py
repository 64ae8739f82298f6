"""Search over story headlines by an inverted index, with the outlets of their articles beside it.

The index is a table of postings (token, id, positions) sorted by token, so a search reads the row
groups of its own tokens. Headlines are cut into lower-case runs of letters and digits; there are
no stems and no stop words. A query holds words, "quoted phrases", OR between alternatives and -word
for what must not occur; what stands side by side must all occur.
"""

from __future__ import annotations

import re
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestory.functions import scalars as S
from lodestory.functions import vocabulary as V
from lodestory.operators.stories import top_k, top_members
from lodestory.storage import cut, scratch

TOKEN = r"[\p{L}\p{N}]+"
#: Longest query, page bounds, and how many headline hits, outlet articles and outlet stories are taken.
MOST_SIGNS, MOST_PAGE, HEADLINES, ARTICLES, OUTLETS = 200, 50, 100, 500, 100


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"))


def postings(stories: DataFrame, id_col: str = "id", text_col: str = "headline") -> DataFrame:
    """token, id, positions (from 0, rising) of every token of every text; a null text has none."""
    long = stories.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "token"))
    return long.groupBy("token", "id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def write_postings(stories: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write the index, in ranges of tokens and sorted by them, and return it."""
    path = path or scratch(stories.sparkSession)
    rows = postings(stories, **columns)
    rows.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.parquet(path)
    return stories.sparkSession.read.schema(rows.schema).parquet(path)


def words(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", text.lower()))


def alternatives(query: str) -> list[list[tuple[tuple[str, ...], bool]]]:
    """The alternatives of a query, each a list of (phrase, wanted)."""
    out: list[list[tuple[tuple[str, ...], bool]]] = [[]]
    for sign, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if bare.lower() == "or" and not sign:
            out.append([])
        elif phrase := words(quoted or bare):
            out[-1].append((phrase, not sign))
    return [a for a in out if a]


def expanded(query: str, synonyms: dict[str, list[str]] | None = None) -> list[str]:
    """The query and, if the whole of it is known, its synonyms."""
    return [query, *(V.SYNONYMS if synonyms is None else synonyms).get(query.lower().strip(), [])]


def matching(index: DataFrame, wanted: list[list[tuple[tuple[str, ...], bool]]], every: DataFrame | None = None) -> DataFrame:
    """Ids of texts that fit an alternative. Phrases are found by positions: their tokens stand one
    after another. `every`: all ids, needed where an alternative only says what must not occur."""
    spark = index.sparkSession
    phrases = sorted({p for a in wanted for p, _ in a})
    if not phrases:
        return index.select("id").limit(0)
    number = {p: k for k, p in enumerate(phrases)}
    needles = spark.createDataFrame([(k, len(p), o, t) for p, k in number.items() for o, t in enumerate(p)], "phrase int, size int, offset int, token string")  # of at most MOST_SIGNS signs
    hits = index.where(F.col("token").isin(sorted({t for p in phrases for t in p}))).join(F.broadcast(needles), "token")
    starts = hits.select("phrase", "size", "id", "offset", F.explode("positions").alias("pos")).groupBy("phrase", "size", "id", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count("*").alias("n"))
    found = starts.where("n = size").groupBy("id").agg(F.collect_set("phrase").alias("has"))
    if every is not None:
        found = every.join(found, "id", "left").withColumn("has", F.coalesce("has", F.array().cast("array<int>")))

    def fits(a):
        return reduce(Column.__and__, [F.array_contains("has", number[p]) == F.lit(yes) for p, yes in a])

    return found.where(S.any_of([fits(a) for a in wanted])).select("id")


def _day_bounds(day: date | str) -> tuple[datetime, datetime]:
    d = date.fromisoformat(day) if isinstance(day, str) else day
    start = datetime.combine(d, time.min)
    return start, start + timedelta(days=1) - timedelta(milliseconds=1)


def within(df: DataFrame, column: str, date_from: date | str | None, date_to: date | str | None) -> DataFrame:
    """Rows from the first to the last instant of whole UTC days; an open end is no predicate."""
    if date_from is not None:
        df = df.where(F.col(column) >= F.lit(f"{_day_bounds(date_from)[0]}").cast("timestamp"))
    if date_to is not None:
        df = df.where(F.col(column) <= F.lit(f"{_day_bounds(date_to)[1]}").cast("timestamp"))
    return df


def search_stories(stories: DataFrame, articles: DataFrame, index: DataFrame, query: str, *, category: str | None = None, date_from: date | str | None = None, date_to: date | str | None = None, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """Stories whose headline fits (the HEADLINES most significant), and beside them the most
    significant of the stories of the newest ARTICLES whose outlet holds the query or a synonym.
    Category and days are tested before the limits; ties by first time and id."""
    if not 1 <= len(query) <= MOST_SIGNS or set("%_") & set(query):
        raise ValueError(f"a query has 1 to {MOST_SIGNS} signs and no wildcards")
    names = expanded(query, synonyms)
    wanted = alternatives(query) if len(names) == 1 else [[(words(n), True)] for n in names if words(n)]
    open_ended = any(not any(yes for _, yes in a) for a in wanted)
    fit = within(stories if category is None else stories.where(F.col("category") == category), "first_published_at", date_from, date_to)
    order = (F.col("significance_score").desc(), F.col("first_published_at").desc(), F.col("id"))
    first = cut(top_k(fit.join(matching(index, wanted, stories.select("id") if open_ended else None), "id", "left_semi"), HEADLINES, *order))
    named = within(articles.where(F.col("cluster_id").isNotNull() & S.contains_any(F.lower("source_name"), [n.lower() for n in names])), "published_at", date_from, date_to)
    fresh = top_k(named.select("cluster_id", "published_at", "id"), ARTICLES, F.col("published_at").desc(), F.col("id")).select(F.col("cluster_id").alias("id")).distinct()
    second = top_k(fit.join(fresh.join(first, "id", "left_anti"), "id", "left_semi"), OUTLETS, *order)
    return first.unionByName(second)


def search_page(stories: DataFrame, articles: DataFrame, index: DataFrame, query: str, *, now: Column, limit: int = 20, offset: int = 0, half_life: int = 60, members: int = 3, **filters) -> DataFrame:
    """One page of a search: pos (from 1), the story's columns, rank_score (significance over one plus
    its age in half-lives) and its first `members` articles as structs of id and title."""
    if not 1 <= limit <= MOST_PAGE or offset < 0:
        raise ValueError(f"a page has 1 to {MOST_PAGE} rows")
    hits = search_stories(stories, articles, index, query, **filters)
    days = (F.unix_micros(now) - F.unix_micros("first_published_at")) / 86_400e6
    hits = hits.withColumn("rank_score", F.round(F.coalesce("significance_score", F.lit(0.0)) / (1 + days / half_life), 6))
    place = F.row_number().over(Window.orderBy(F.col("rank_score").desc(), "id"))  # at most HEADLINES + OUTLETS rows
    page = hits.withColumn("pos", place - offset).where((F.col("pos") > 0) & (F.col("pos") <= limit))
    top = top_members(articles.join(page.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi"), members)
    shown = top.groupBy(F.col("cluster_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "title"))), lambda m: F.struct(m["id"].alias("id"), m["title"].alias("title"))).alias("articles"))
    return page.join(shown, "id")  # a story without articles is not shown
