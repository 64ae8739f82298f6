"""Packing of documents into sequences by bulk-synchronous best fit.

In each round the larger of the unplaced pieces and all gaps are range-sorted by size, largest
first, gaps before pieces of the same size. A sweep reads them as brackets (a gap opens, a piece
closes): each piece meets the nearest gap before it that is still free, the smallest gap that
holds it when larger pieces choose first and equal ones by rank. Tasks sweep their ranges, the
ranges' sums carry the sweep on, and a piece's gap is the row before it on its level, so a
round moves small rows a few times however many pieces there are. A gap that holds several
of a round's pieces is offered as equal slots. Pieces that meet no gap open new sequences in
runs of as many as surely fit; gaps shrink and the next round takes the smaller pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestory.llm.encoding import encoder
from lodestory.llm.shared import cut, prepare
from lodestory.llm.token_store import encoder_ids

#: The last round places all pieces up to this share of a sequence.
SMALL = 1 / 16


def pieces_of(docs: DataFrame, vocabulary: str, *, limit: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents over the limit
    are cut; then all pieces but the first have the full length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, True)
        for b in batches:
            ids, n = encoder_ids(enc, b.column(1), end_id)
            cuts = -(-n // limit)
            row = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            first = n - (cuts - 1) * limit
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * limit)
            length = np.where(piece == 0, first[row], limit)
            at = (np.cumsum(n) - n)[row] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * s : 4 * (s + k)]) for s, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def depths(both: DataFrame) -> DataFrame:
    """Ranks gaps (kind 0) and pieces (kind 1) by size, largest first, and adds `before`: the gaps
    less the pieces in front. Rows are range-sorted, each task counts through its range, and the
    ranges' sums (a row a task) are added up; equal sizes are split by a hash of the id."""
    order = [F.col("size").desc(), F.col("kind"), F.col("_tie"), F.col("id"), F.col("slot")]
    rows = both.withColumn("_tie", F.xxhash64("id", "slot")).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            step = 1 - 2 * b.column(1).to_numpy().astype(np.int64)
            ahead = at + np.cumsum(step)
            at = int(ahead[-1]) if len(ahead) else at
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(step), part, np.int32)), pa.array(ahead - step)], [*b.schema.names, "part", "within"])

    counted = cut(rows.select("size", "kind", "id", "slot").mapInArrow(count, "size long, kind int, id long, slot int, part int, within long"))
    sums = counted.groupBy("part").agg(F.sum(1 - 2 * F.col("kind")).alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return counted.join(base, "part").select("size", "kind", "id", (F.col("base") + F.col("within")).alias("before"))


def place(gaps: DataFrame, now: DataFrame, *, limit: int, most: int, least: int) -> DataFrame:
    """One superstep: pid, length, sequence_id, opened for every piece of `now`, all of `least` to `most` tokens.

    Read as brackets, a gap opens a level and a piece closes it; a piece's gap is the row before it
    on its level. Pieces without one are the first of their levels 0, -1, -2, ..., so the level
    also numbers them by size, and runs of as many as a sequence surely holds open one together.
    """
    # a gap may take several pieces at once: it stands for as many equal slots as hold any of them
    slots = F.greatest(F.lit(1), F.floor(F.col("gap") / most)).cast("int")
    open_slots = gaps.where(F.col("gap") >= least).select(F.floor(F.col("gap") / slots).cast("long").alias("size"), F.lit(0).alias("kind"), F.col("sequence_id").alias("id"), F.explode(F.sequence(F.lit(1), slots)).alias("slot"))
    both = open_slots.unionByName(now.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("pid").alias("id"), F.lit(0).alias("slot")))
    level = F.col("before") + 1 - F.col("kind")
    line = Window.partitionBy("level").orderBy(F.col("size").desc(), "kind")
    met = (
        depths(both)
        .withColumn("level", level)
        .withColumn("gap_kind", F.lag("kind").over(line))
        .withColumn("gap_id", F.lag("id").over(line))
        .where("kind = 1")
        .select(F.col("id").alias("pid"), F.col("size").alias("length"), F.when(F.col("gap_kind") == 0, F.col("gap_id")).alias("gap_id"), "level")
    )
    fits = F.floor(F.lit(limit) / F.col("length"))
    run = F.when(F.col("gap_id").isNull(), F.struct(fits.alias("fits"), F.floor(-F.col("level") / fits).alias("run")))
    # of matched pieces each is a run of its own
    runs = Window.partitionBy("run", F.when(F.col("gap_id").isNotNull(), F.col("pid"))).orderBy(F.col("level").desc())
    opener = F.first("pid").over(runs)
    return met.withColumn("run", run).select("pid", "length", F.coalesce("gap_id", opener).alias("sequence_id"), (F.col("gap_id").isNull() & (opener == F.col("pid"))).alias("opened"))


def best_fit(pieces: DataFrame, *, limit: int) -> DataFrame:
    """Places pieces (pid long, length long): returns pid, length, sequence_id, opened, round.

    A sequence has the pid of the piece that opened it. Pieces over half the limit never share
    and open at once; then each round takes all pieces over half the largest size left, and all
    places are final, so there are at most five rounds, whatever the input. A run ends where
    the number that fits changes; the last of each number's runs may stay part empty, which costs some
    dozens of sequences at most, whatever the input. Rows of equal size are ordered by hash and pid, so the result is fixed.
    """
    pieces = pieces.select("pid", "length")
    large = pieces.where(F.col("length") * 2 > limit)
    placed = [cut(large.select("pid", "length", F.col("pid").alias("sequence_id"), F.lit(True).alias("opened"), F.lit(0).alias("round")))]
    gaps = placed[0].select("sequence_id", (F.lit(limit) - F.col("length")).alias("gap")).where("gap > 0")
    most = limit // 2
    while most > 0:
        least = most // 2 + 1 if most > SMALL * limit else 1
        now = pieces.where(F.col("length").between(least, most))
        got = cut(place(gaps, now, limit=limit, most=most, least=least).withColumn("round", F.lit(len(placed))))
        placed.append(got)
        change = got.select("sequence_id", (F.when(F.col("opened"), F.lit(limit)).otherwise(0) - F.col("length")).alias("gap"))
        most = least - 1
        if most:
            gaps = cut(gaps.unionByName(change).groupBy("sequence_id").agg(F.sum("gap").alias("gap")).where("gap > 0"))
    return reduce(DataFrame.unionByName, placed)


def pack_documents(docs: DataFrame, vocabulary: str, *, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `limit` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty:
    one piece of the end id. Rows that repeat are packed each for itself; nulls in the id and
    other columns do no harm; an empty frame gives no rows.
    """
    prepare(docs.sparkSession)
    pieces = cut(pieces_of(docs, vocabulary, limit=limit, end_id=end_id, id_col=id_col, text_col=text_col).withColumn("pid", F.monotonically_increasing_id()))
    where = best_fit(pieces, limit=limit).drop("length")
    before = Window.partitionBy("sequence_id").orderBy("round", "pid").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.join(where, "pid")
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    )
