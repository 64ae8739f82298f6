"""Near-duplicate documents by consistent weighted sampling over TF-IDF word shingles.

Each text is a weighted set of five-word shingles: frequency in the text times a damped inverse
document frequency. Improved consistent weighted sampling draws samples that two sets share with
probability equal to their weighted Jaccard similarity; bands of samples collect candidates, and
true weighted similarity verifies them. In a band's bucket a central document is compared with
the others first, so copies join one class without all pairs; what is then still apart in a
bucket and could be linked, by an exact bound on the weight that texts share, is compared pair
by pair, so that no candidate link between classes is lost.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestory.llm.shared import buffer_of, cut, mix, own_cache, prepare, slices, trim, words_of
from lodestory.operators.graph import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Buckets of the table that tells which shingles may be frequent.
DF_BUCKETS = 1 << 20
#: Shingles in more than one of so many documents are frequent and counted one by one; at most
#: this many times the mean number of a document's shingles are.
FREQUENT = 1000
#: The most that a shingle's document frequency takes off its weight. Undamped IDF would give
#: the shingles that a third of all documents share almost no weight, and hide those copies.
IDF_SPAN = 0.2
#: Rounds of comparisons with one document of a bucket before the rest is compared in pairs.
STAR_ROUNDS = 4
DRAW_ROWS = 1 << 14
#: Shingles that a task holds before it adds them up.
HELD = 1_000_000


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of each text's shingles, repeats included; a shorter text is one shingle of all its words."""
    words, first = words_of(data, offsets)
    mult = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, size + 1)], np.uint64)
    full = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        full += words[k : k + len(full)] * mult[k]
    full = mix(full)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= size:
            yield full[lo : hi - size + 1]
        elif hi > lo:
            yield mix((words[lo:hi] * mult[: hi - lo]).sum(keepdims=True, dtype=np.uint64) + np.uint64(hi - lo))
        else:
            yield full[:0]


def weighted(hashes: np.ndarray, idf: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order, and their weights: frequency in the text times IDF, 1 for rare ones."""
    keys, tf = np.unique(hashes, return_counts=True)
    frequent, value = idf
    weight = tf.astype(np.float64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        weight *= np.where(frequent[at] == keys, value[at], 1.0)
    return keys, weight


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta for each sample, one row per value of some bits of a hash, each of bits of its own."""
    draws = own_cache("draws")
    if "t" not in draws:
        rng = np.random.default_rng(20)
        shape = (DRAW_ROWS, BANDS * ROWS)
        r, c = (rng.standard_gamma(2.0, shape, np.float32) for _ in range(2))
        draws["t"] = np.maximum(r, 1e-6), np.log(np.maximum(c, 1e-30)), rng.random(shape, np.float32)
    return draws["t"]


def band_hashes(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Hash of each band's samples (shingle and quantised weight)."""
    r, c, beta = _tables()
    best = np.full(BANDS * ROWS, np.inf, np.float32)
    sample = np.zeros(BANDS * ROWS, np.uint64)
    low = np.uint64(DRAW_ROWS - 1)
    for lo in range(0, len(keys), 2048):
        k = keys[lo : lo + 2048]
        rr, bb = r[(k & low).astype(np.int64)], beta[(k >> np.uint64(16) & low).astype(np.int64)]
        t = np.floor(np.log(weights[lo : lo + 2048]).astype(np.float32)[:, None] / rr + bb)
        a = c[(k >> np.uint64(32) & low).astype(np.int64)] - rr * (t - bb + 1)
        at = a.argmin(0)
        least = a[at, np.arange(a.shape[1])]
        better = least < best
        best[better] = least[better]
        drawn = mix(k[at] + t[at, np.arange(a.shape[1])].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sample[better] = drawn[better]
    mult = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(ROWS)], np.uint64)
    return mix((sample.reshape(BANDS, ROWS) * mult).sum(1, dtype=np.uint64)).view(np.int64)


def inverse_frequencies(docs: DataFrame, *, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles (sorted) and the IDF of each, from counts over all documents.

    IDF falls with the logarithm of the share of documents that have the shingle, from 1 at one in
    FREQUENT to 1 - IDF_SPAN at all, so it is alike at every size; shingles below that have 1. Two
    passes: bucket counts first, then exact counts of the shingles in buckets that are full enough.
    Tasks add their rows up before they send them; the driver gets DF_BUCKETS numbers and the
    frequent shingles.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        own_cache("draws")
        for b in batches:
            data, offsets = buffer_of(b.column(0))
            for lo, hi in slices(offsets):
                yield [np.unique(h) for h in shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) if len(h)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(DF_BUCKETS, np.int64), 0
        for got in texts(batches):
            n += len(got)
            if got:
                table += np.bincount((np.concatenate(got) >> np.uint64(44)).astype(np.int64), minlength=DF_BUCKETS)
        for part, x in enumerate(np.split(table, 64)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n if part == 0 else 0], pa.int64()), pa.array([x.astype(np.int32 if n < 1 << 31 else np.int64).tobytes()], pa.binary())], ["part", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for part, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(raw, np.int32 if len(raw) == DF_BUCKETS // 16 else np.int64)
                s = sums.setdefault(part, [0, np.zeros(DF_BUCKETS // 64, np.int64)])
                s[0] += n
                s[1] += x
        for part, (n, x) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["part", "n", "counts"])

    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    schema = "part int, n long, counts binary"
    parts = docs.select(text_col).mapInArrow(count, schema).repartition(64, "part").mapInArrow(add, schema).toArrow().sort_by("part")
    n = sum(parts["n"].to_pylist())
    if not n:
        return none
    least = max(2, n // FREQUENT)
    full = docs.sparkSession.sparkContext.broadcast(np.packbits(np.concatenate([np.frombuffer(x, np.int64) for x in parts["counts"].to_pylist()]) >= least))  # 128 KB
    del parts
    trim()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.unpackbits(full.value).astype(bool)
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, many = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(many.astype(np.int64))], ["key", "n"])

        for got in texts(batches):
            held += [h[open_[(h >> np.uint64(44)).astype(np.int64)]] for h in got]
            if sum(map(len, held)) >= HELD:
                yield flush()
        if held:
            yield flush()

    counts = docs.select(text_col).mapInArrow(exact, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    if not len(counts):
        return none
    keys, df = counts["key"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    order = np.argsort(keys)
    value = 1 - IDF_SPAN * np.log(df[order] / least) / max(np.log(n / least), 1e-9)
    return keys[order], value.astype(np.float32)


def _may_link(similarity: float, sa: Column, ta: Column, sb: Column, tb: Column) -> Column:
    """Whether two texts could reach the similarity: what they share is at most the smaller shared weight."""
    return F.least(sa, sb) * (1 + similarity) >= (similarity - 1e-6) * (ta + tb)


def shared_weights(texts: DataFrame, idf) -> DataFrame:
    """node, total, shared: the weight of each text's shingles, and of those that another of these
    texts has too. Counts are summed in the tasks before they move."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffer_of(b.column(1))
            for lo, hi in slices(offsets, 1 << 18):
                sets = [weighted(h, idf.value) for h in shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])]
                n = [len(k) for k, _ in sets]
                nodes = b.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), n)))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(np.concatenate([k for k, _ in sets]).view(np.int64)), pa.array(np.concatenate([w for _, w in sets]).astype(np.float64))], ["node", "key", "weight"])

    rows = texts.select("node", "text").mapInArrow(spread, "node binary, key long, weight double")
    single = rows.groupBy("key").agg(F.count("*").alias("n"), F.any_value("node").alias("node"), F.any_value("weight").alias("weight")).where("n = 1")
    alone = single.groupBy("node").agg(F.sum("weight").alias("alone"))
    total = rows.groupBy("node").agg(F.sum("weight").alias("total"))
    return total.join(alone, "node", "left").select("node", "total", (F.col("total") - F.coalesce("alone", F.lit(0.0))).alias("shared"))


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, class_id, n_links for every row: class_id is the smallest id of the class.

    Two texts are linked when their weighted Jaccard similarity is `similarity` or more; classes
    are what links connect; equal texts are always of one class. n_links counts verified links
    of the row's text. Texts without words (null, empty) are each their own class (class_id = id).
    A null id counts after all others. Repeated rows get the same class. Empty in, empty out.
    """
    spark = prepare(docs.sparkSession)
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs, text_col=text_col))  # frequent shingles only
    kind = dict(docs.dtypes)[id_col]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = buffer_of(b.column(1))
            bands = []
            for lo, hi in slices(offsets):
                for h in shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]):
                    bands.append(band_hashes(*weighted(h, idf.value)) if len(h) else None)
            node = [hashlib.md5(data[lo:hi]).digest() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "node", "bands"])

    signed = cut(docs.select(id_col, text_col).mapInArrow(sign, f"id {kind}, node binary, bands array<long>"))
    nodes = cut(signed.where("bands is not null").groupBy("node").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands")))
    placed = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    crowds = placed.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(placed.join(crowds, ["band", "hash"]).select(F.struct("band", "hash").alias("bucket"), "node", "n"))
    # how crowded a text's buckets are: the middle of a group of copies meets most of it
    central = members.groupBy("node").agg(F.sum("n").alias("weight"))
    members = cut(members.select("bucket", "node").join(central, "node"))
    chosen = members.select("node").distinct().join(nodes.select("node", "id"), "node")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), F.unhex(F.md5(text_col)).alias("_node"))
    texts = texts.join(chosen, texts["_node"].eqNullSafe(chosen["node"]) & texts["_id"].eqNullSafe(chosen["id"])).select("node", "text")
    texts = cut(texts.groupBy("node").agg(F.any_value("text").alias("text")))

    def verify(pairs: DataFrame) -> DataFrame:
        side = texts.withColumnRenamed("text", "text_b")
        one = pairs.join(side, pairs["b"] == side["node"]).select("a", "b", "text_b")
        full = one.join(texts, one["a"] == texts["node"]).select("a", "b", "text", "text_b")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: OrderedDict[bytes, tuple] = OrderedDict()

            def features(node: bytes, text: str) -> tuple:
                if node not in kept:
                    data, offsets = buffer_of(pa.array([text]))
                    kept[node] = weighted(next(iter(shingles(data, offsets))), idf.value)
                    if len(kept) > 64:
                        kept.popitem(last=False)
                else:
                    kept.move_to_end(node)
                return kept[node]

            for x in batches:
                a, b, ta, tb = (c.to_pylist() for c in x.columns)
                s = [weighted_jaccard(features(*p), features(*q)) for p, q in zip(zip(a, ta, strict=True), zip(b, tb, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(s, pa.float64())], ["a", "b", "similarity"])

        return cut(full.mapInArrow(compare, "a binary, b binary, similarity double"))

    verified, labels, used = None, None, None
    for k in range(STAR_ROUNDS + 1):
        if labels is None:
            now = members.withColumn("label", F.col("node"))
        else:
            now = members.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
            apart = now.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
            now = cut(now.join(apart, "bucket"))
        if k == 1:
            # exact bounds: no similarity is above shared / total, nor above what the smaller shared
            # weight of two texts gives; most of what the first stars leave apart cannot be linked
            bounds = shared_weights(now.select("node").distinct().join(texts, "node"), idf)
            now = now.join(bounds, "node").where(F.col("shared") >= (similarity - 1e-6) * F.col("total"))
            now = cut(now)
        if k:
            members = now.drop("label")
        own, other = (F.struct("shared", "total"), F.col("h.head.bound")) if k else (F.lit(None), None)
        if k < STAR_ROUNDS:
            # the most central text that has not been a head before
            order = F.struct("weight", "node", own.alias("bound"))
            able = now if used is None else now.join(used, "node", "left_anti")
            groups = able.groupBy("bucket", "label").agg(F.count("*").alias("size"), F.max(order).alias("head"))
            heads = groups.groupBy("bucket").agg(F.max(F.struct("size", "head", "label")).alias("h"))
            heads = heads.select("bucket", F.col("h.head.node").alias("a"), F.col("h.label").alias("head_label"), *([other.alias("bound")] if k else []))
            heads = cut(heads)
            taken = heads.select(F.col("a").alias("node")).distinct()
            used = taken if used is None else used.unionByName(taken)
            pairs = now.join(heads, "bucket").where("label <> head_label")
            if k:
                pairs = pairs.where(_may_link(similarity, F.col("shared"), F.col("total"), F.col("bound.shared"), F.col("bound.total")))
            pairs = pairs.select("a", F.col("node").alias("b")).distinct()
        else:
            now = now.join(nodes.select("node", "bands"), "node")
            left = now.select("bucket", F.col("node").alias("a"), F.col("label").alias("la"), F.col("shared").alias("sa"), F.col("total").alias("ta"), F.col("bands").alias("ba"))
            right = now.select("bucket", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("shared").alias("sb"), F.col("total").alias("tb"), F.col("bands").alias("bb"))
            # a pair that meets in several bands is taken in the first
            first = F.array_position(F.zip_with("ba", "bb", lambda x, y: x == y), True) == F.col("bucket.band") + 1
            fit = F.expr("a < b and la <> lb") & _may_link(similarity, F.col("sa"), F.col("ta"), F.col("sb"), F.col("tb")) & first
            pairs = left.join(right, "bucket").where(fit).select("a", "b")
        if verified is not None:
            known = verified.select(F.least("a", "b").alias("ka"), F.greatest("a", "b").alias("kb"))
            pairs = pairs.join(known, (F.least("a", "b") == known["ka"]) & (F.greatest("a", "b") == known["kb"]), "left_anti")
        found = verify(pairs)
        verified = found if verified is None else verified.unionByName(found)
        # between rounds labels only spare comparisons, and one step joins every star; those before the pairs, which
        # would else meet within a class too, and the last are exact
        labels = connected_components(verified.where(F.col("similarity") >= similarity).select("a", "b"), steps=None if k >= STAR_ROUNDS - 1 else 1)
    links = verified.where(F.col("similarity") >= similarity).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = nodes.select("node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = classes.groupBy("label").agg(F.min("id").alias("class_id"))
    classes = classes.join(heads, "label").join(degree, "node", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = signed.select("id", "node", F.col("bands").isNull().alias("silent")).join(classes, "node", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("silent"), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, with all their columns, one for each class (its smallest id).

    Of rows that repeat both that id and the text one stays. Texts without words all stay.
    """
    classes = near_duplicate_classes(docs, id_col=id_col, text_col=text_col, similarity=similarity)
    heads = classes.where(F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("_head")).distinct()
    # columns get names of their own, so that none of the frame's can clash
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(docs.columns)])
    i, t = (F.col(f"_c{docs.columns.index(c)}") for c in (id_col, text_col))
    rows = rows.join(heads, i.eqNullSafe(heads["_head"]), "left_semi")
    rank = F.row_number().over(Window.partitionBy(i, F.md5(t)).orderBy(t.asc_nulls_last()))
    return rows.withColumn("_rank", rank).where("_rank = 1").select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])
