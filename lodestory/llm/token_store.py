"""A store of token ids: frequency-ranked ids in byte-aligned codes of one to four bytes.

A block holds the ids of consecutive documents. Its ids are replaced by their rank of
frequency in the block, so common ids take one byte. The lengths of four codes share one
control byte; control bytes and code bytes are kept apart, so that a table of 256 rows gives
all lengths at once and numpy gathers the codes. Blocks are rows of Parquet files, which any
store that Spark writes to can hold, and which Spark commits only when a task is done.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestory.llm.encoding import encoder
from lodestory.llm.shared import prepare

#: Ids of a block, at least, unless the partition ends; a block ends with a document.
BLOCK_IDS = 2_000_000
#: Lengths of the four codes under each control byte, first code in the low bits.
CODE_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked ids as unsigned 32-bit, control bytes, code bytes) of a block."""
    if not len(ids):
        return b"", b"", b""
    counts = np.bincount(ids)
    ranked = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    rank_of = np.zeros(len(counts), "<u4")
    rank_of[ranked] = np.arange(len(ranked))
    r = rank_of[ids]
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = r.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = size - 1
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    return ranked.tobytes(), control.tobytes(), codes.tobytes()


def unpack_ids(ranked: bytes, control: bytes, codes: bytes, n: int) -> np.ndarray:
    """The n ids of a block."""
    if not n:
        return np.zeros(0, np.uint32)
    size = CODE_LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(size) - size
    data = np.frombuffer(codes + b"\0\0\0", np.uint8)
    r = data[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not more.size:
            break
        r[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[r]


def write_token_store(
    docs: DataFrame, path: str, vocabulary: str, *, spaces: bool, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS
) -> None:
    """Encode all texts and write them in ascending id order as blocks under `path`.

    Null ids come first; rows of equal id are ordered by their text. A null text is empty (just
    the end id). Rows are dealt out by ranges of the id, so no task sees more than its range.
    """
    prepare(docs.sparkSession)
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(vocabulary, spaces), TaskContext.get().partitionId(), 0
        ids, lens, keys = [], [], []

        def block() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            ranked, control, codes = pack_ids(flat)
            row = {"part": part, "seq": seq, "doc_ids": pa.chunked_array(keys).to_pylist(), "lens": np.concatenate(lens).tolist(), "ranked": ranked, "control": control, "codes": codes}
            return pa.RecordBatch.from_pylist([row], _BLOCK)

        for b in batches:
            x, n = encoder_ids(enc, b.column(1), end_id)
            ids.append(x)
            lens.append(n)
            keys.append(b.column(0))
            if sum(map(len, ids)) >= block_ids:
                yield block()
                seq += 1
                ids, lens, keys = [], [], []
        if ids:
            yield block()

    ordered.mapInArrow(run, "part int, seq int, doc_ids array<long>, lens array<int>, ranked binary, control binary, codes binary").write.option("compression", "none").parquet(path)


_BLOCK = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("ranked", pa.binary()), ("control", pa.binary()), ("codes", pa.binary())])


def encoder_ids(enc, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with the end id after each, and the number of each."""
    ids, n = enc.encode(texts)
    if end_id is None:
        return ids, n
    out = np.full(len(ids) + len(n), end_id, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(n + 1) - 1] = False
    out[keep] = ids
    return out, n + 1


def read_token_store(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """Rows of a store: doc_id, start (ids of all documents before), n_tokens, ids_crc32[, ids].

    Starts come from sums by file part (as many rows as the writer had tasks) and by block.
    """
    prepare(spark)
    blocks = spark.read.parquet(path)
    sizes = blocks.select("part", "seq", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "base")
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("base") + F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                lens = np.array(row["lens"], np.int64)
                ids = unpack_ids(row["ranked"], row["control"], row["codes"], int(lens.sum()))
                ends = np.cumsum(lens)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lens.tolist(), strict=True)]
                cols = [pa.array(np.full(len(lens), row["part"], np.int32)), pa.array(np.full(len(lens), row["seq"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lens), pa.array(lens), pa.array(crc, pa.int64())]
                names = ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([x.tolist() for x in np.split(ids.astype(np.int64), ends[:-1])], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    docs = blocks.mapInArrow(run, schema).join(starts, ["part", "seq"])
    return docs.select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
