"""Writes as operators: Parquet has no MERGE, so each gives the table's next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestory.sources.keyed import create_new

def insert_ignore(stored: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows and the first new row of each key that is not stored."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return stored.unionByName(first.join(stored.select(key), key, "left_anti").select(stored.columns))


def upsert(stored: DataFrame, new: DataFrame, key: str, *, overwrite: list[str], keep: list[str]) -> DataFrame:
    """New values win in `overwrite`; in `keep` a new null leaves the old value."""
    n = new.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in (*overwrite, *keep)], F.lit(True).alias("_new"))
    j = stored.join(n, key, "full_outer")
    cols = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in overwrite]
    cols += [F.coalesce(f"_{c}", c).alias(c) for c in keep]
    return j.select(key, *cols)


def upsert_by_precedence(stored: DataFrame, new: DataFrame, keys: list[str], value: str, *, primary: str) -> DataFrame:
    """A row of the primary source is only replaced by another of the primary source."""
    n = new.select(*keys, F.col(value).alias("_v"), F.col("source").alias("_s"))
    wins = F.col("_s").isNotNull() & (F.col("source").isNull() | (F.col("source") != primary) | (F.col("_s") == primary))
    j = stored.join(n, keys, "full_outer")
    return j.select(*keys, F.when(wins, F.col("_v")).otherwise(F.col(value)).alias(value), F.when(wins, F.col("_s")).otherwise(F.col("source")).alias("source"))


def upsert_adopt(stored: DataFrame, new: DataFrame) -> DataFrame:
    """For new (epoch_key, slug) rows: matched by key, adopted by slug where the stored row has no
    key, collided where it has another, or inserted. Returns new rows with `outcome` and `id`."""
    by_key = stored.where("epoch_key is not null").select("epoch_key", F.col("id").alias("_k"))
    by_slug = stored.select("slug", F.col("id").alias("_s"), F.col("epoch_key").alias("_e"))
    j = new.join(by_key, "epoch_key", "left").join(by_slug, "slug", "left")
    outcome = F.when(F.col("_k").isNotNull(), "matched").when(F.col("_s").isNull(), "inserted").when(F.col("_e").isNull(), "adopted").otherwise("collided")
    return j.select("epoch_key", "slug", outcome.alias("outcome"), F.coalesce("_k", F.when(F.col("_e").isNull(), F.col("_s"))).alias("id"))


def gated_append(stored: DataFrame, new: DataFrame, key: str, at: str, now: Column, hours: int = 20) -> DataFrame:
    """Rows of keys that have no stored row within the last hours."""
    recent = stored.where(F.col(at) > now - F.make_dt_interval(F.lit(0), F.lit(hours))).select(key)
    return new.join(recent, key, "left_anti")


def link_ignore_max(models: DataFrame, links: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with the new ones, models whose significance rose to that of a newly linked story)."""
    fresh = new.join(links, ["model_id", "cluster_id"], "left_anti")
    top = fresh.groupBy(F.col("model_id").alias("id")).agg(F.max("significance_score").alias("_m"))
    risen = models.join(top, "id", "left").withColumn("significance", F.greatest("significance", "_m")).drop("_m")
    return links.unionByName(fresh.select("model_id", "cluster_id").distinct()), risen


def fold_waitlist(rows: DataFrame) -> DataFrame:
    """One row per lower-case email, as repeated sign-ups leave it: the first digest source is
    final, else the first source; `stack` changes only until then, and never to null."""
    rows = rows.withColumn("email", F.lower("email")).withColumn("digest", F.col("source").startswith("digest"))
    final = F.min(F.when(F.col("digest"), F.col("event_id"))).over(Window.partitionBy("email"))
    live = rows.withColumn("_f", final).where(F.col("_f").isNull() | (F.col("event_id") <= F.col("_f")))
    source = F.coalesce(F.min_by("source", F.when(F.col("digest"), F.col("event_id"))), F.min_by("source", "event_id"))
    return live.groupBy("email").agg(source.alias("source"), F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("event_id"))).alias("stack"))


def reset_assignments(articles: DataFrame, now: Column, hours: int) -> tuple[DataFrame, DataFrame]:
    """Membership without the last hours (clamped to 1..168), and the stories that are left with
    their counts, first times and the day of most articles (the earliest of equals)."""
    hours = min(168, max(1, hours))
    inside = F.col("published_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))
    members = articles.withColumn("cluster_id", F.when(~inside, F.col("cluster_id")))
    days = members.where("cluster_id is not null").groupBy(F.col("cluster_id").alias("id"), F.to_date("published_at").alias("day")).agg(F.count("*").alias("n"), F.min("published_at").alias("first"))
    return members, days.groupBy("id").agg(F.sum("n").alias("article_count"), F.min("first").alias("first_published_at"), F.min_by("day", F.struct(-F.col("n"), "day")).alias("peak_date"))


def delete_set_null(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children of deleted parents lose their reference."""
    g = gone.select(F.col(key).alias("_g")).distinct()
    return children.join(g, children[key] == g["_g"], "left").withColumn(key, F.when(F.col("_g").isNull(), F.col(key))).drop("_g")


class VersionedTable:
    """A table whose versions are folders; the newest complete one (Spark's _SUCCESS) counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._at = jvm.org.apache.hadoop.fs.Path
        self.last = 0

    def versions(self) -> list[str]:
        if not self._fs.exists(self._root):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(v for v in found if v.startswith("v") and self._fs.exists(self._at(f"{self.path}/{v}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version (of a number under `before`), or None."""
        v = [x for x in self.versions() if before is None or int(x[1:]) < before]
        self.last = int(v[-1][1:]) if v else 0
        return self.spark.read.parquet(f"{self.path}/{v[-1]}") if v else None

    def write(self, df: DataFrame, version: int | None = None) -> None:
        """Write a whole new version beside the old one; readers see it when it is complete.

        Versions are numbered: the next one is that after the version read last. Its number is claimed
        first, by a file that only one writer can create; if another has it the write fails rather
        than hide the other's rows. A caller
        that numbers its versions itself (a micro-batch) may write the same one again after a
        crash: a complete one stays as it is, an incomplete one is replaced.
        """
        number = self.last + 1 if version is None else version
        name = f"v{number:020d}"
        if version is not None and name in self.versions():
            return
        if version is None and not create_new(self.spark, f"{self.path}/{name}.claim", ""):
            raise FileExistsError(f"version {number} of {self.path} exists or is being written")
        df.write.mode("errorifexists" if version is None else "overwrite").parquet(f"{self.path}/{name}")
        self.last = number
