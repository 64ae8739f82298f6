"""Exact dedup against a persistent index of text digests.

The index is a table in buckets of the digest, sorted by digest in each bucket. What arrives is
grouped by digest (partial sums before the shuffle), anti-joined to the index by sort-merge, where
the index side needs no exchange, and what is new is appended, already in the table's buckets.

Rules: texts are equal when identical after lower-casing A-Z only; a null text is empty. Of an
arrival's equal texts the row with the largest id stays, and one that an earlier arrival holds
keeps the place. A null id is smaller than any. Rows that repeat id and text are judged alike
(`keep_new` returns one of them). Ids that are text go by their order as text. Empty tables give empty answers.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestory.llm.shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest with more than this share of the rows is hot; there can be no more than 1,000 of them.
HOT_SHARE = 1 / 1000


def text_digest(text: str) -> F.Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest"))


class DigestIndex:
    """A folder with a bucketed Parquet table (digest, keep_id, arrival) and its layout.

    `DigestIndex(spark, path)` opens the index there, or makes an empty one in `buckets` buckets
    (the session's shuffle partitions if not given) for ids of type `id_type`. Any later session
    opens it by path alone.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            buckets, id_type = spark.read.parquet(f"{self.path}/layout").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(buckets, id_type)], "buckets int, id_type string").coalesce(1).write.parquet(f"{self.path}/layout")
        self.buckets, self.id_type = buckets, id_type
        self.name = "digests_" + hashlib.md5(self.path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}, arrival STRING) USING parquet "
            f"OPTIONS (path '{self.path}/entries') CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS"
        )

    def entries(self) -> DataFrame:
        """digest, keep_id, arrival: one row per digest."""
        return self.spark.table(self.name)

    def admit(self, rows: DataFrame, arrival: str) -> DataFrame:
        """Take in rows of (id, digest) as one arrival and return its entries (digest, keep_id, arrival).

        An arrival is complete once its append is; given again under the same name, after a failure
        or by mistake, it finds its own entries and adds nothing.
        """
        new = cut(rows.groupBy("digest").agg(F.max("id").alias("keep_id")))  # else the anti-join goes below the sums and moves every row
        held = self.entries().select("digest").hint("merge")
        new.join(held, "digest", "left_anti").select("digest", "keep_id", F.lit(arrival).alias("arrival")).write.insertInto(self.name)
        return self.entries().where(F.col("arrival") == arrival)


def exact_duplicates(docs: DataFrame, index: DigestIndex, *, arrivals: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, keep_id (of the row that stays), group_size (equal texts in `docs`), kept, text_sha256.

    The table arrives in parts, the largest ids first, so that of all equal texts the one with the
    largest id is the first to come. Against an index that holds earlier data `keep_id` may name a
    document of those. A hot digest's rows never meet in one task: there are at most 1,000 such
    digests, they are joined by broadcast, the others by sort-merge.
    """
    rows = cut(digests(docs, id_col, text_col))
    total = rows.count()
    shares = [k / arrivals for k in range(arrivals - 1, 0, -1)] if dict(rows.dtypes)["id"] in ("int", "bigint") else []
    bounds = rows.approxQuantile("id", shares, 0.01) if shares else []
    above = None
    for k, low in enumerate([*bounds, None]):
        inside = F.lit(True) if low is None else F.col("id") >= low
        if above is not None:
            inside &= F.col("id").isNull() | (F.col("id") < above)
        index.admit(rows.where(inside), f"{k}")
        above = low if low is not None else above
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = cut(sizes.join(index.entries().select("digest", "keep_id").hint("merge"), "digest"))
    is_hot = F.col("group_size") > total * HOT_SHARE
    hot = F.broadcast(groups.where(is_hot))
    found = rows.join(hot, "digest").unionByName(rows.join(hot.select("digest"), "digest", "left_anti").join(groups.where(~is_hot).hint("merge"), "digest"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_new(docs: DataFrame, index: DigestIndex, arrival: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text no earlier arrival holds; of equal
    texts the one with the largest id. Columns may have any names."""
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at, text = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    mine = index.admit(digests(plain, at, text), arrival).select("digest", "keep_id")
    stay = plain.withColumn("_digest", text_digest(text)).join(mine, (F.col("_digest") == F.col("digest")) & F.col(at).eqNullSafe(F.col("keep_id")), "left_semi")
    return stay.dropDuplicates([at, "_digest"]).drop("_digest").toDF(*names)
