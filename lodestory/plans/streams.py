"""Streaming queries over the driver's tables, replayed to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestory.plans.catalog import query
from lodestory.plans.vectors import DIST, OWN
from lodestory.shipping import ship
from lodestory.sources.fixtures import NEWS, Fixtures
from lodestory.storage import cut, scratch
from lodestory.streaming import streams as R


#: Rows of a landed file, about.
FILE_ROWS = 500_000


def replay(x: Fixtures, df: DataFrame, order: str, batches: int = 4, cuts: list | None = None) -> DataFrame:
    """A table as a stream that arrives in the order of a column, in so many micro-batches.

    The cuts, or else the column's quantiles, part the rows; each part lands after the part before as the same
    number of files, so the file source, which reads by time of change, takes them one by one. The table is
    made once; files grow in number, not in size.
    """
    path, df = scratch(x.spark), cut(df)
    at = F.unix_micros(order) if dict(df.dtypes)[order] == "timestamp" else F.col(order)
    rows, quantiles = df.agg(F.count("*"), F.percentile_approx(at, [(k + 1) / batches for k in range(batches - 1)])).first()
    edges = [None, *sorted(set(cuts or quantiles or [])), None]
    files = max(1, -(-rows // ((len(edges) - 1) * FILE_ROWS)))
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        part = df if low is None else df.where(at > low)
        part = part if high is None else part.where(at <= high)
        part.repartition(files).write.mode("append").parquet(path)
        for _ in range((k + 1) * files - len(x.spark.read.parquet(path).inputFiles())):  # a part of fewer rows than files
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return R.read_stream(x.spark, path, files=files)


@query("K1_stream_dedup_url_title", "SELECT DISTINCT source_url FROM articles")
def _(x: Fixtures):
    return R.run_to_end(R.dedup(replay(x, x.articles().select("id", "source_url", "published_at"), "published_at"), ["source_url"], "published_at", 60)).select("source_url")


@query("K2_stream_debounced_prices")
def _(x):
    ship(x.spark)
    return R.run_to_end(R.debounced(replay(x, x.price_samples(), "sample_ts")))


@query("K3_stream_daily_gate")
def _(x):
    ship(x.spark)
    return R.run_to_end(R.gated(replay(x, x.events().select("user_id", "ts"), "ts"), "user_id", "ts"))


@query("K4_stream_peak_day", "SELECT cluster_id, arg_min(day, (-n, day)) AS peak_date FROM (SELECT cluster_id, CAST(published_at AS DATE) AS day, count(*) AS n FROM articles WHERE cluster_id IS NOT NULL GROUP BY ALL) GROUP BY 1")
def _(x):
    rows = replay(x, x.articles().where("cluster_id is not null").select("cluster_id", "published_at"), "published_at")
    path = scratch(x.spark)
    # update mode gives a day's count again whenever it grows; the largest is the last
    R.run_batches(R.day_counts(rows, "cluster_id", "published_at"), lambda b, _: b.write.mode("append").parquet(path))
    days = x.spark.read.parquet(path).groupBy("cluster_id", "day").agg(F.max("count").alias("n"))
    return days.groupBy("cluster_id").agg(F.min_by("day", F.struct(-F.col("n"), "day")).alias("peak_date"))


@query("K5_stream_run_gaps", "SELECT count(*) AS runs, sum(new) AS spans FROM (SELECT CASE WHEN lag(ran_at) OVER (ORDER BY ran_at) IS NULL OR epoch_us(ran_at) - epoch_us(lag(ran_at) OVER (ORDER BY ran_at)) >= 4 * 3600000000 THEN 1 ELSE 0 END AS new FROM pipeline_runs)")
def _(x):
    path = scratch(x.spark)
    spans = R.active_spans(replay(x, x.pipeline_runs().withColumn("job", F.lit("refresh")), "ran_at"), "job", "ran_at")
    # complete mode gives all spans with each batch; the last batch has them all
    R.run_batches(spans, lambda b, k: b.withColumn("k", F.lit(k)).write.mode("append").parquet(path), "complete")
    done = x.spark.read.parquet(path)
    last = done.groupBy().agg(F.max("k").alias("k"))  # one row
    return done.join(F.broadcast(last), "k").agg(F.sum("count").alias("runs"), F.count("*").alias("spans"))


@query("K6_stream_rolling_top", "SELECT until, user_id, total FROM (SELECT d AS until, user_id, round(sum(value), 4) AS total FROM events, range(0, 60) r(k), LATERAL (SELECT DATE '2024-01-01' + CAST(k AS INT) AS d) WHERE CAST(ts AS DATE) < d AND CAST(ts AS DATE) >= d - 7 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY until ORDER BY total DESC, user_id) <= 3")
def _(x):
    from lodestory.operators.stories import first_per_key

    path = scratch(x.spark)
    totals = R.rolling_top(replay(x, x.events().select("user_id", "value", "ts"), "ts"), "user_id", "value", "ts")
    R.run_batches(totals, lambda b, k: b.withColumn("k", F.lit(k)).write.mode("append").parquet(path))
    last = x.spark.read.parquet(path).groupBy("until", "user_id").agg(F.round(F.max_by("total", "k"), 4).alias("total"))
    return first_per_key(last, ["until"], F.col("total").desc(), "user_id", k=3)


@query("K7_stream_upsert_registry", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def _(x):
    rows = replay(x, x.events().select("user_id", "event_type", "event_id"), "event_id")
    table = R.upsert_batches(rows, scratch(x.spark), "user_id", order="event_id", overwrite=["event_type"], keep=["event_id"])
    return table.read().select("user_id", "event_type")


@query("K8_stream_time_join", "SELECT a.id, b.id AS other FROM articles a JOIN articles b ON a.source_url = b.source_url AND a.id < b.id AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 48 * 3600000000")
def _(x):
    rows = replay(x, x.articles().select("id", "source_url", F.col("published_at").alias("at")), "at")
    return R.run_to_end(R.time_join(rows, rows, "source_url"))


@query("K9_stream_late_backfill", f"""SELECT m.id, late, other, rank FROM marked m LEFT JOIN (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY {DIST.format("va.v", "vb.v")}, b.id) AS rank
    FROM marked a JOIN marked b ON a.late AND a.id <> b.id AND b.k <= a.k AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 172800000000 JOIN vec va ON va.id = a.id JOIN vec vb ON vb.id = b.id WHERE {DIST.format("va.v", "vb.v")} < 0.6 QUALIFY rank <= 10) n ON n.id = m.id""",
    landed="SELECT id, published_at, CASE WHEN id * 37 % 101 <= 25 THEN 0 WHEN id * 37 % 101 <= 50 THEN 1 WHEN id * 37 % 101 <= 75 THEN 2 ELSE 3 END AS k FROM articles",
    marked="""SELECT id, published_at, k, coalesce(published_at < seen - INTERVAL 48 HOURS, false) AS late FROM landed LEFT JOIN (
    SELECT k, max(newest) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT k, max(published_at) AS newest FROM landed GROUP BY 1)) USING (k)""",
    vec=OWN["vec"],
)
def _(x):
    """Articles land in an order other than that of their times, so many come late; each late one still meets those
    of its own time."""
    v = x.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    a = x.articles().select("id", "published_at", (F.col("id") * 37 % 101).alias("landing")).join(v, "id", "left")
    rows, near = R.late_backfill(replay(x, a, "landing", cuts=[25, 50, 75]), scratch(x.spark), F.lit(NEWS))
    return rows.select("id", "late").join(near.select("id", "other", "rank"), "id", "left")
