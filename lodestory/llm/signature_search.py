"""Ranked lexical search over bit-sliced Bloom signatures.

The index is a table of blocks of documents. A document's signature is a Bloom filter of its terms
and of how often they occur (term and step: the term occurs at least so many times); signatures
of about equal size stand side by side as slices, one bitmap over the documents for each bit. The
bitwise AND of a term's slices overestimates which documents hold it, and how often; weighted
sums of that bound every document's score from above. Documents whose bound reaches the best
scores found so far are scored exactly from their term lists in the block, the others provably
do not belong to the answer.

A task runs through its blocks and keeps its own best of each query; Spark ranks those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestory.llm.shared import LOWER, MULT, WORD, buffer_of, mix, prefix_hash, prepare, ragged, range_hash, scratch

#: Text of a block, queries' terms of one pass, and cells of a bit matrix, at most about.
BLOCK_BYTES, QUERY_BYTES, CELLS = 2 << 20, 8 << 20, 8 << 20
#: Documents of a block and items of a pass, at most about; terms times documents whose bounds are held at once.
BLOCK_DOCS, QUERY_ITEMS, BOUNDS = 4096, 1 << 14, 4 << 20
#: A row group holds a few blocks: Spark decodes a group as a whole, and a writer keeps one in memory.
GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
#: A term that occurs at least so many times sets the bits of that step.
STEPS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512, 1024], np.int64)
HASHES, BITS_PER_KEY = 3, 8
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "ids array<long>, n array<long>, terms array<string>, df array<long>, start array<long>, code binary, tf binary, slices array<struct<bits:int,first:int,docs:int,rows:binary>>"


def block_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms of texts one after another: the distinct ones, the number of each occurrence's
    term, and each text's first occurrence (n + 1). Terms are told apart by their bytes."""
    inside = WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = inside[edge]
    start = np.flatnonzero(first)
    whole = np.ascontiguousarray(LOWER[data][inside])
    at = np.append(np.cumsum(inside)[start] - 1, len(whole)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(whole)]).dictionary_encode()
    return words.dictionary.cast(pa.large_string()), words.indices.to_numpy(), np.searchsorted(start, offsets)


def term_hashes(terms: pa.Array) -> np.ndarray:
    data, offsets = buffer_of(terms)
    return range_hash(prefix_hash(data), offsets[:-1], offsets[1:])


def bit_places(h: np.ndarray, step: np.ndarray | int, bits: int) -> np.ndarray:
    """HASHES places in a signature of `bits` (a power of two) for each term hash at a step."""
    x = mix(h + (np.atleast_1d(step).astype(np.uint64) + np.uint64(1)) * MULT)
    return np.stack([(mix(x + np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64) for k in range(HASHES)], -1)


def index_block(ids: pa.Array, texts: pa.Array) -> dict | None:
    """One block as a row of the index; texts without terms are left out."""
    data, offsets = buffer_of(texts)
    terms, code, edge = block_terms(data, offsets)
    n = np.diff(edge)
    doc = np.repeat(np.arange(len(n)), n)
    key, tf = np.unique(doc * max(1, len(terms)) + code, return_counts=True)
    doc, code = key // max(1, len(terms)), key % max(1, len(terms))
    # documents by the size of their signatures
    reached = np.searchsorted(STEPS, tf, "right")
    keys = np.bincount(doc, weights=reached, minlength=len(n)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    order = order[keys[order] > 0]
    if not len(order):
        return None
    bits = 1 << np.ceil(np.log2(np.maximum(64, keys[order] * BITS_PER_KEY))).astype(np.int64)
    lo, size = np.searchsorted(doc, order), np.bincount(doc, minlength=len(n))[order]
    take = ragged(lo, size)
    code, tf, reached = code[take], tf[take], reached[take]
    start = np.concatenate([[0], np.cumsum(size)])
    h, slices, s = term_hashes(terms), [], 0
    while s < len(order):
        m = int(bits[s])
        e = min(int(np.searchsorted(bits, m, "right")), s + max(1, CELLS // m))
        cells = np.zeros((m, e - s), bool)
        at = slice(start[s], start[e])
        owner = np.repeat(np.arange(e - s), size[s:e])
        pairs = np.repeat(np.arange(len(owner)), reached[at])
        step = ragged(np.zeros(len(owner), np.int64), reached[at].astype(np.int64))
        cells[bit_places(h[code[at]][pairs], step, m), owner[pairs][:, None]] = True
        slices.append({"bits": m, "first": s, "docs": e - s, "rows": np.packbits(cells, axis=1).tobytes()})
        s = e
    df = np.bincount(code, minlength=len(terms)).astype(np.int64)
    return {"ids": ids.take(pa.array(order)), "n": n[order], "terms": terms, "df": df, "start": start, "code": code.astype(np.int32), "tf": tf.astype(np.int32), "slices": slices}


def write_signature_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the index of all whole texts as Parquet and return it; ids must be integers."""
    spark = prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer column, not {kind}")
    kinds = {"ids": pa.int64(), "n": pa.int64(), "terms": pa.string(), "df": pa.int64(), "start": pa.int64()}

    def row(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        found = index_block(t.column(0).combine_chunks(), t.column(1).combine_chunks())
        if found:
            cols = [pa.ListArray.from_arrays(pa.array([0, len(found[c])], pa.int32()), (v if isinstance(v := found[c], pa.Array) else pa.array(v)).cast(k)) for c, k in kinds.items()]
            step = np.diff(found["code"], prepend=np.int32(0))  # codes of a document ascend, so most steps are small
            cols += [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (step, found["tf"])]
            slices = pa.array([found["slices"]], pa.list_(pa.struct([("bits", pa.int32()), ("first", pa.int32()), ("docs", pa.int32()), ("rows", pa.binary())])))
            yield pa.RecordBatch.from_arrays([*cols, slices], [*kinds, "code", "tf", "slices"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0
        for b in batches:
            held.append(b)
            size, docs = size + b.column(1).nbytes, docs + len(b)
            if size >= BLOCK_BYTES or docs >= BLOCK_DOCS:
                yield from row(held)
                held, size, docs = [], 0, 0
        if held:
            yield from row(held)

    docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, INDEX).write.options(**GROUPS).parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Queries:
    """Items with their terms' weights, as arrays that a task takes."""

    def __init__(self, items: list, terms: list[list[str]], weight: dict[str, int]):
        self.items = items
        self.terms = sorted({t for ts in terms for t in ts if weight.get(t)})  # a term of weight 0 adds nothing
        at = {t: k for k, t in enumerate(self.terms)}
        self.weight = np.array([weight[t] for t in self.terms], np.int64)
        self.of = [np.array(sorted(at[t] for t in ts if t in at), np.int64) for ts in terms]
        self.hash = term_hashes(pa.array(self.terms, pa.string()))


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Block:
    """A row of the index, ready to be searched."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.ids, self.n = row["ids"], row["n"]
        self.terms, self.start, self.code, self.tf, self.slices = row["terms"], row["start"], row["code"], row["tf"], row["slices"]
        self.m = 50 + (50 * self.n * n_docs) // n_terms

    def bounds(self, q: Queries, known: np.ndarray) -> Iterator[np.ndarray]:
        """For each group of documents in turn what each known term of the queries adds at most to each document."""
        for s in self.slices:
            m, a, docs = s["bits"], s["first"], s["docs"]
            rows = np.frombuffer(s["rows"], np.uint8).reshape(m, -1)
            n, b = self.n[a : a + docs], self.m[a : a + docs]
            most = [np.zeros(docs, np.int64)]
            for k in range(len(STEPS)):
                most.append(saturation(np.minimum(n, STEPS[k + 1] - 1 if k + 1 < len(STEPS) else n), b))
            level = np.zeros((len(known), docs), np.uint8)
            live, before = np.arange(len(known)), None
            for k in range(len(STEPS)):
                places = bit_places(q.hash[known[live]], k, m)
                here = np.bitwise_and.reduce([rows[places[:, j]] for j in range(HASHES)])
                if before is not None:
                    here &= before
                some = here.any(1)
                live, before = live[some], here[some]
                if not len(live):
                    break
                level[live] += np.unpackbits(before, axis=1, count=docs)
            yield np.stack(most).astype(np.float32)[level, np.arange(docs)]

    def exact(self, docs: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """Scores of documents, worth: the weight of each of the block's terms."""
        size = self.start[docs + 1] - self.start[docs]
        at = ragged(self.start[docs], size)
        w, owner = worth[self.code[at]], np.repeat(np.arange(len(docs)), size)
        hit = np.flatnonzero(w)
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, owner[hit], w[hit] * saturation(self.tf[at[hit]].astype(np.int64), self.m[docs[owner[hit]]]))
        return out


class Best:
    """The k best (score, id) of each query so far; of equal scores the smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.ids = k, [np.zeros(0, np.int64)] * queries, [np.zeros(0, np.int64)] * queries
        self.least = np.ones(queries, np.int64)
        self.scored = self.seen = 0

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[i], score]), np.concatenate([self.ids[i], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[i], self.ids[i] = score[order], ids[order]
        if len(order) == self.k:
            self.least[i] = self.score[i][-1]


def item_groups(known: list[np.ndarray], n: int, most: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Runs of items of at most about `most` distinct known terms in all, with those terms (numbers under n)."""
    items, held = [], np.zeros(n, bool)
    for i, mine in enumerate(known):
        if not len(mine):
            continue
        if items and np.count_nonzero(held) + np.count_nonzero(~held[mine]) > most:
            yield items, np.flatnonzero(held)
            items, held = [], np.zeros(n, bool)
        items.append(i)
        held[mine] = True
    if items:
        yield items, np.flatnonzero(held)


def item_bounds(block: Block, q: Queries, known: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Items with known terms, and what bounds each document's score from above."""
    most = max(1, BOUNDS // max(1, len(block.n)))
    place = np.zeros(len(q.terms), np.int64)
    for items, terms in item_groups(known, len(q.terms), most):
        if len(terms) > most:  # one item
            parts = (terms[s : s + most] for s in range(0, len(terms), most))
            yield items[0], sum((q.weight[p].astype(np.float32) @ np.concatenate(list(block.bounds(q, p)), 1)).astype(np.float64) for p in parts)
            continue
        place[terms] = np.arange(len(terms))
        gain = np.concatenate(list(block.bounds(q, terms)), 1)
        for i in items:
            yield i, (q.weight[known[i]].astype(np.float32) @ gain[place[known[i]]]).astype(np.float64)


def search_block(block: Block, q: Queries, best: Best) -> None:
    """Score what the bounds don't exclude: the most promising documents first, then those that
    still reach the least score of the best."""
    code = pc.index_in(pa.array(q.terms, pa.string()), value_set=block.terms.cast(pa.string())).fill_null(-1).to_numpy().astype(np.int64)
    known = [of[code[of] >= 0] for of in q.of]
    valid = block.ids.is_valid().to_numpy(zero_copy_only=False)
    ids = block.ids.fill_null(0).to_numpy()
    worth = np.zeros(len(block.terms), np.int64)
    for i, bound in item_bounds(block, q, known):
        mine = known[i]
        codes = code[mine]
        worth[codes] = q.weight[mine]
        bound = np.where(valid, bound * (1 + (len(mine) + 4) * 2e-7), 0)  # above all rounding
        best.seen += int(valid.sum())
        head = np.flatnonzero(bound >= best.least[i])
        if len(head) > best.k:
            top = np.argpartition(-bound[head], best.k - 1)[: best.k]
            rest = np.delete(head, top)
            head = head[top]
        else:
            rest = head[:0]
        for docs in (head, rest):
            docs = docs[bound[docs] >= best.least[i]]
            if len(docs):
                score = block.exact(docs, worth)
                best.scored += len(docs)
                keep = score > 0
                best.add(i, score[keep], ids[docs[keep]])
        worth[codes] = 0


def _blocks(batches: Iterator[pa.RecordBatch], n_docs: int, n_terms: int) -> Iterator[Block]:
    for b in batches:
        for r in range(b.num_rows):
            row = {c: b.column(c)[r].values for c in ("ids", "n", "terms", "start")}
            row |= {c: row[c].to_numpy() for c in ("n", "start")} | {c: np.frombuffer(b.column(c)[r].as_buffer(), "<i4") for c in ("code", "tf")}
            row["code"] = np.cumsum(row["code"], dtype=np.int32)
            yield Block(row | {"slices": b.column("slices")[r].as_py()}, n_docs, n_terms)


def query_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, terms: each item's distinct terms; rows of one id are one item, null ids are left out."""
    words = F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, SMALL), F.lit(TERM), F.lit(0)))
    return items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), words.alias("term")).distinct().groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def search_signatures(spark: SparkSession, index: DataFrame, items: DataFrame, *, k: int = 50, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest scores above 0 of each item.

    Terms, weights and scores are those of the module's contract: w = floor(1000 ln((2N+2)/(2df+1))),
    score the sum of w * ((10^9 tf) div (1000 tf + 20 m)), m = 50 + (50 n N) div L. Null texts have no
    terms; documents with a null id count in N, L and df but are never returned; equal scores go by
    ascending id; repeated rows rank each; an empty index or no items give no rows. Items are
    searched in blocks of QUERY_BYTES of terms or QUERY_ITEMS.
    """
    prepare(spark)
    kind = dict(items.dtypes)[item_col]
    out = None
    total = index.agg(F.sum(F.size("ids")).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
    for names, terms in _query_blocks(query_terms(items, item_col, text_col)) if total["docs"] else ():
        wanted = spark.createDataFrame([(t,) for t in sorted({t for ts in terms for t in ts})], "term string")  # at most QUERY_BYTES
        pairs = index.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.df").alias("df"))
        df = {r["term"]: r["df"] for r in pairs.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * d + 1))) for t, d in df.items()}
        sent = spark.sparkContext.broadcast(Queries(names, terms, weight))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q = sent.value
            best = Best(len(q.items), k)
            for block in _blocks(batches, total["docs"], total["terms"]):
                search_block(block, q, best)
            sizes = [len(s) for s in best.score]
            if sum(sizes):
                of = pa.array(q.items).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([of, pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.score))], [item_col, "doc_id", "score"])

        part = index.select("ids", "n", "terms", "start", "code", "tf", "slices").mapInArrow(run, f"{item_col} {kind}, doc_id long, score long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{item_col} {kind}, rank int, doc_id long, score long")
    line = Window.partitionBy(item_col).orderBy(F.col("score").desc(), "doc_id")
    return out.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select(item_col, "rank", "doc_id", "score")


def _query_blocks(items: DataFrame) -> Iterator[tuple[list, list[list[str]]]]:
    names, terms, size = [], [], 0
    for r in items.toLocalIterator():
        names.append(r["item"])
        terms.append(r["terms"])
        size += sum(map(len, r["terms"]))
        if size >= QUERY_BYTES or len(names) >= QUERY_ITEMS:
            yield names, terms
            names, terms, size = [], [], 0
    if names:
        yield names, terms


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Index all documents in the shared folder, then search every item."""
    spark = docs.sparkSession
    index = write_signature_index(docs, scratch(spark), id_col=id_col, text_col=text_col)
    return search_signatures(spark, index, items, k=k, item_col=item_col, text_col=item_text_col).withColumnRenamed("doc_id", id_col)
