"""URL filters: explicit rules first, then trust and distrust spread over the host graph.

Hosts link to the hosts that their pages' links name. Personalised PageRank from trusted hosts
along the links gives trust; from blocked hosts against the links it gives distrust (who links
to bad places is bad). A host is blocked if its share of distrust outweighs its trust. Trust
also passes between a host and its parent domain, lightly; distrust never does, so kinship may
clear a host but not block it. Edges are summed by host pair before ranks move, so a host with
many pages is no heavier than its distinct neighbours.

Ranks spread to their limit in supersteps. Hosts are dealt into blocks of bounded size, a site's
together; in a superstep each block spreads the mass that came to it along its own edges to the
end, and what leaves the blocks moves in Spark. Which edges count as a block's own changes the
number of supersteps, not the limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestory.llm.shared import cut, prepare

#: (verdict, host, path): a rule fits its host and all subdomains, and paths that start with its own.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
#: Ranks are spread until all the mass still to come is under this share.
TOLERANCE = 1e-6
#: A host is blocked if distrust is over this many times its trust.
OUTWEIGHS = 1.0
#: Lineage is cut after so many rounds of the power iteration.
CUT_EVERY = 4
#: Hosts of a block, about, and the most edges of a host that may be its block's own.
BLOCK_HOSTS, OWN_EDGES = 50_000, 64
#: Weight of all edges of one host to its kin; one link weighs 1, and a host without links keeps the rest.
KIN = 0.1
#: Sums kept before they are added up.
MOST_PARTS = 16


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, from its `/` on, up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest fitting rule; nulls if none fits.

    Length counts the characters of host and path; of equals the first by text, then block.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), [-ord(c) for c in r[1] + r[2]], r[0] == "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links of pages from host to host. A link without a host stays on its own and
    is no edge between hosts; a link with `//` but no scheme keeps its page's scheme."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    links = pages.where(F.col(html_col).contains("//")).select(host_of(F.col(url_col)).alias("src"), F.explode(hrefs).alias("href"))
    full = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    return links.select("src", host_of(full).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def parent_edges(hosts: DataFrame) -> DataFrame:
    """src, dst, n: edges between each host and its parent domain, both ways. A host gives KIN to its
    parent, and a parent KIN to its children together. Parents with one label (com, org) are no site."""
    labels = F.split("host", r"\.")
    parent = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, 2, F.size(labels)), "."))
    up = hosts.select(F.col("host").alias("src"), parent.alias("dst")).where("dst is not null").distinct()
    families = up.groupBy("dst").agg((F.lit(KIN) / F.count("*")).alias("n"))
    down = up.join(families, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    return up.withColumn("n", F.lit(KIN)).unionByName(down)


def with_kin(links: DataFrame, kin: DataFrame) -> DataFrame:
    """Links and kin edges (src, dst, n); a host with kin and no link keeps what kin does not get."""
    linked = links.select("src").distinct()
    rest = kin.select("src").distinct().join(linked, "src", "left_anti")
    own = rest.select("src", F.col("src").alias("dst"), F.lit(1 - KIN).alias("n"))
    both = links.withColumn("n", F.col("n").cast("double")).unionByName(kin).unionByName(own)
    return both.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def blocks_of(hosts: DataFrame, size: int) -> DataFrame:
    """host, block: hosts of one site (the last two labels) together, but those of a site that is
    larger than a block, which are dealt out one by one."""
    n = -(-hosts.count() // size)
    sites = hosts.withColumn("site", F.substring_index("host", ".", -2))
    large = sites.groupBy("site").agg(F.count("*").alias("n"))
    key = F.when(F.col("n") > size, F.xxhash64("host")).otherwise(F.xxhash64("site"))
    return sites.join(large, "site").select("host", F.pmod(key, F.lit(max(1, n))).alias("block"))


def _spread(came: pa.Table, edges: pa.Table) -> pa.Table:
    """All the mass that a block's hosts see when what came spreads along the block's own edges."""
    if not len(came):
        return pa.table({"kind": pa.array([], pa.string()), "host": pa.array([], pa.string()), "gain": pa.array([], pa.float64())})
    names = pa.concat_arrays([c for col in (came["host"], edges["src"], edges["dst"]) for c in col.chunks]).dictionary_encode()
    at, src, dst = np.split(names.indices.to_numpy(), [len(came), len(came) + len(edges)])
    n, p = len(names.dictionary), edges["p"].to_numpy()
    moving = np.bincount(at, came["m"].to_numpy(), n)
    gain, least = moving.copy(), 1e-12 * moving.sum()
    while len(p) and moving.sum() > least:
        moving = np.bincount(dst, moving[src] * p, n)
        gain += moving
    some = np.flatnonzero(gain > 0)
    return pa.table({"kind": pa.array([came["kind"][0].as_py()] * len(some), pa.string()), "host": names.dictionary.take(pa.array(some)), "gain": pa.array(gain[some])})


def converged_pagerank(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE, block_hosts: int = BLOCK_HOSTS) -> DataFrame:
    """kind, host, rank: the limit of personalised_pagerank, for edges and seeds of several kinds at once.

    With dead ends returning to the seeds, the limit is the sum over k of what the seeds' mass
    comes to after k steps along the edges (each damped), made to sum to 1. What a mass may still
    bring is at most 1 / (1 - damping) times it, so the error is bounded by the tolerance.
    """
    prepare(edges.sparkSession)
    seeds = seeds.where("weight > 0").groupBy("kind", "host").agg(F.sum("weight").alias("weight"))
    totals = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))  # one row a kind
    start = seeds.join(F.broadcast(totals), "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("m"))
    hosts = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct()
    placed = cut(blocks_of(cut(hosts), block_hosts))
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"), F.count("*").alias("many"))
    moves = edges.join(out, ["kind", "src"]).join(placed.select(F.col("host").alias("src"), "block"), "src").join(placed.select(F.col("host").alias("dst"), F.col("block").alias("to")), "dst")
    own = (F.col("block") == F.col("to")) & (F.col("many") <= OWN_EDGES)
    moves = cut(moves.select("kind", "block", "src", "dst", (damping * F.col("n") / F.col("total")).alias("p"), own.alias("own")))
    inside, across = moves.where("own").drop("own"), moves.where("not own").select("kind", "src", "dst", "p")
    came = cut(start.join(placed, "host").select("kind", "block", "host", "m"))
    gains: list[DataFrame] = []

    def total() -> DataFrame:
        return reduce(DataFrame.unionByName, gains).groupBy("kind", "host").agg(F.sum("gain").alias("gain"))

    while True:
        gain = cut(came.groupBy("kind", "block").cogroup(inside.groupBy("kind", "block")).applyInArrow(_spread, "kind string, host string, gain double"))
        gains.append(gain)
        if len(gains) == MOST_PARTS:
            gains = [cut(total())]
        moved = gain.withColumnRenamed("host", "src").join(across, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("gain") * F.col("p")).alias("m"))
        came = cut(moved.join(placed, "host").select("kind", "block", "host", "m"))
        if (came.agg(F.sum("m")).first()[0] or 0.0) / (1 - damping) <= tolerance:
            break
    state = total()
    sums = state.groupBy("kind").agg(F.sum("gain").alias("total"))  # one row a kind
    return state.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("gain") / F.col("total")).alias("rank"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, *, rounds: int | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, rank: rank mass starts at the seeds (host, weight), follows edges (src, dst, n) in
    proportion to n, and returns to the seeds with probability 1 - damping or from dead ends.

    Given rounds, as it stands after so many; else at convergence. The mass is 1 in every round.
    No seeds, no rows.
    """
    if rounds is None:
        one = F.lit("")
        return converged_pagerank(edges.withColumn("kind", one), seeds.withColumn("kind", one), damping=damping, tolerance=tolerance).drop("kind")
    seeds = seeds.where("weight > 0").groupBy("host").agg(F.sum("weight").alias("weight"))
    total = seeds.agg(F.sum("weight").alias("total"))  # one row
    start = cut(seeds.crossJoin(F.broadcast(total)).select("host", (F.col("weight") / F.col("total")).alias("share")))
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    steps = cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("p")))
    rank = start.select("host", F.col("share").alias("rank"))
    for k in range(1, rounds + 1):
        moved = rank.join(steps, rank["host"] == steps["src"]).groupBy("dst").agg((damping * F.sum(F.col("rank") * F.col("p"))).alias("m"))
        lost = moved.agg((1 - F.coalesce(F.sum("m"), F.lit(0.0))).alias("lost"))
        back = start.crossJoin(F.broadcast(lost)).select("host", (F.col("share") * F.col("lost")).alias("m"))  # one row
        rank = moved.select(F.col("dst").alias("host"), "m").unionByName(back).groupBy("host").agg(F.sum("m").alias("rank"))
        if k % CUT_EVERY == 0 or k == rounds:
            rank = cut(rank)
    return rank


def judge_urls(pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", outweighs: float = OUTWEIGHS) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and its host's trust and distrust.

    Verdict is the longest rule's; without one it is `block` where the host's distrust is over
    `outweighs` times its trust, else `allow` (also for an empty host or no seeds at all). Null
    urls have empty host and path and fit no rule; repeated rows are judged alike; an empty table
    gives no rows; other columns have no effect.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("by_rule", verdict)
    counts = cut(judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("good"), F.count_if(F.col("by_rule") == "block").alias("bad"), F.count("*").alias("pages")))
    links = cut(host_edges(pages, url_col=url_col, html_col=html_col))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").cast("double"))
    both = cut(with_kin(links, parent_edges(counts.select("host"))).withColumn("kind", F.lit("trust")).unionByName(back.withColumn("kind", F.lit("distrust"))))
    seeds = counts.select(F.lit("trust").alias("kind"), "host", F.col("good").alias("weight")).unionByName(counts.select(F.lit("distrust").alias("kind"), "host", F.col("bad").alias("weight")))
    rank = cut(converged_pagerank(both, seeds))
    trust, distrust = (rank.where(F.col("kind") == k).select("host", "rank") for k in ("trust", "distrust"))
    hosts = counts.select("host").join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left").na.fill(0.0, ["trust", "distrust"])
    spread = F.when(F.coalesce(F.col("distrust") > outweighs * F.col("trust"), F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    out = judged.join(hosts, "host", "left")
    return out.select(id_col, "host", "path", "rule", F.coalesce("by_rule", spread).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
