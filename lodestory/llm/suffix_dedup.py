"""Removal of byte strings that occurred before, with suffix arrays over content-dealt shards.

Every window of LENGTH bytes has one anchor: the start of its smallest-hashed GRAM bytes. Equal
windows have equal anchors, so stretches of windows with one anchor can be dealt out by the
anchor's hash, and all windows of equal bytes meet in one shard. A stretch whose whole text
occurred before is removed at once; only where different stretches share an anchor (the ends
of repeats) is their text gathered, and shard by shard a suffix array with permuted common
prefixes finds the windows that occurred before. An anchor in very many different stretches is
split into its single windows, which are dealt out to the shards by their own hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestory.llm.induced import permuted_prefixes, suffix_array
from lodestory.llm.shared import buffer_of, cut, mix, own_cache, prefix_hash, prepare, ragged, range_hash, slices, spans_of

LENGTH, GRAM = 100, 32
#: Different stretches of one anchor above which they are split into windows.
HOT = 20_000
#: Bytes of a suffix-array shard, about.
SHARD_BYTES = 1 << 20
#: Stretches that a task holds before it looks for repeats among its own.
HELD = 1_000_000
#: Windows of a longer text are taken in blocks of so many.
BLOCK = 1 << 22


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, text hash, row, first window's start, number of windows) of all stretches."""
    n, grams = len(data), LENGTH - GRAM + 1
    size = np.diff(offsets)
    if n < LENGTH:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    h = prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = range_hash(h, at, at + GRAM)
    low = np.uint64((1 << 26) - 1)
    m = (gram & ~low) | at.astype(np.uint64)
    width = 1
    while width * 2 <= grams:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (grams - width)], m[grams - width :])
    anchor = (m & low).astype(np.int64)
    row = np.flatnonzero(size >= LENGTH)
    s = ragged(offsets[row], size[row] - LENGTH + 1)
    a = anchor[s]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)))) if len(s) else np.zeros(0, np.int64)
    start, count, a = s[first], np.diff(first, append=len(s)), a[first]
    text = mix(range_hash(h, start, start + count + LENGTH - 1) ^ mix((a - start).astype(np.uint64)))
    return gram[a], text, np.searchsorted(offsets, start, "right") - 1, start, count


def all_stretches(arr: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of a batch of texts: hashes, row of the batch, start in the text, windows."""
    data, offsets = buffer_of(arr)
    for lo, hi in slices(offsets):
        size = int(offsets[hi] - offsets[lo])
        if hi - lo == 1 and size > BLOCK + LENGTH:
            for w in range(0, size - LENGTH + 1, BLOCK):
                part = data[offsets[lo] + w : min(offsets[hi], offsets[lo] + w + BLOCK + LENGTH - 1)]
                key, text, _, start, count = stretches(part, np.array([0, len(part)]))
                yield key, text, np.full(len(key), lo), start + w, count
        else:
            local = offsets[lo : hi + 1] - offsets[lo]
            key, text, row, start, count = stretches(data[offsets[lo] : offsets[hi]], local)
            yield key, text, row + lo, start - local[row], count


_STRETCH = "key long, text long, uid long, start long, windows long, done boolean"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of a partition's texts; those that repeat within it leave as covered ranges."""
    own_cache("suffix")
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        key, text, uid, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        both = mix(key ^ mix(text))
        order = np.lexsort((start, uid, both))
        again = np.concatenate(([False], both[order][1:] == both[order][:-1]))
        new, old = np.sort(order[~again]), order[again]
        yield _batch(key[new].view(np.int64), text[new].view(np.int64), uid[new], start[new], count[new], False)
        if len(old):
            u, s, e = merged(uid[old], start[old], start[old] + count[old] + LENGTH - 1)
            yield _batch(mix(u.view(np.uint64) ^ s.view(np.uint64)).view(np.int64), np.zeros(len(u), np.int64), u, s, e - s, True)

    total = 0
    for b in batches:
        ids = b.column(0).to_numpy()
        for key, text, row, start, count in all_stretches(b.column(1)):
            held.append((key, text, ids[row], start, count))
            total += len(key)
        if total >= HELD:
            yield from flush()
            total = 0
    if held:
        yield from flush()


def _batch(key, text, uid, start, count, done: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, text, uid, start, count)] + [pa.array(np.full(len(key), done), pa.bool_())], ["key", "text", "uid", "start", "windows", "done"])


def merged(uid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each text united where they touch, sorted."""
    order = np.lexsort((start, uid))
    uid, start, end = uid[order], start[order], end[order]
    if not len(uid):
        return uid, start, end
    other = np.concatenate(([True], uid[1:] != uid[:-1]))
    # the furthest end so far within each text: texts are kept apart by a large step
    base = np.cumsum(other) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = other.copy()
    new[1:] |= (start + base)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(uid)])) - 1
    return uid[first], start[first], reach[last] - base[last]


def repeated_windows(texts: list[bytes], uid: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(uid, place) of windows in a shard of stretches that equal a window at an earlier (uid, place)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(b"\0".join(texts) + b"\0" * 9, np.uint8)
    t = raw[: begin[-1] + size[-1] + 1].astype(np.int64) + 2
    t[begin + size] = 1
    t[-1] = 0
    sa = suffix_array(t, 258)
    count = size - LENGTH + 1
    owner = np.full(len(t), -1)
    place = ragged(begin, count)
    owner[place] = np.repeat(np.arange(len(texts)), count)
    order = sa[owner[sa] >= 0]
    common = permuted_prefixes(raw, order, LENGTH)[order]
    run = np.cumsum(common < LENGTH)
    pair = np.flatnonzero(np.concatenate((common[1:] >= LENGTH, [False])) | (common >= LENGTH))
    order, run = order[pair], run[pair]
    u, p = uid[owner[order]], start[owner[order]] + order - begin[owner[order]]
    turn = np.lexsort((p, u, run))
    later = np.concatenate(([False], run[turn][1:] == run[turn][:-1])) if len(turn) else np.zeros(0, bool)
    return u[turn][later], p[turn][later]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over stretches that arrive in the order of their anchors, ids and places; a row
    without bytes is a window known to be repeated. Single windows of one key, of which there may
    be any number, are searched part by part, the first of each kind once more in each part."""
    own_cache("suffix")
    texts: list[bytes] = []
    ids: list[tuple[int, int]] = []
    known: list[tuple[int, int]] = []
    held, since, last = 0, 0, None

    def flush() -> pa.RecordBatch:
        pairs = np.array(ids, np.int64).reshape(-1, 2)
        u, p = repeated_windows(texts, pairs[:, 0], pairs[:, 1]) if texts else (pairs[:, 0], pairs[:, 1])
        more = np.array(known, np.int64).reshape(-1, 2)
        known.clear()
        u, p = np.concatenate([u, more[:, 0]]), np.concatenate([p, more[:, 1]])
        return _ranges(*merged(u, p, p + LENGTH))

    for b in batches:
        for key, uid, start, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != last:
                if held >= SHARD_BYTES:
                    yield flush()
                    texts, ids, held = [], [], 0
                since, last = len(texts), key
            elif held >= SHARD_BYTES and text is not None and len(text) == LENGTH:
                yield flush()
                first: dict[bytes, tuple[int, int]] = {}
                for t, i in zip(texts[since:], ids[since:], strict=True):
                    first.setdefault(t, i)
                texts, ids, held, since = list(first), list(first.values()), 0, 0
            held += LENGTH if text is None else len(text)
            if text is None:
                known.append((uid, start))
            else:
                texts.append(text)
                ids.append((uid, start))
    if texts or known:
        yield flush()


def _ranges(u: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["uid", "start", "end"])


def by_uid(texts: DataFrame) -> DataFrame:
    """Texts dealt out by uid: one exchange, which the two joins of a plan share."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.select("uid", "text").repartition(n, "uid")


def covered_ranges(texts: DataFrame) -> DataFrame:
    """uid, start, end: bytes of `texts` (unique uid long, text) covered by windows that occurred
    before, in parts that may overlap."""
    dealt = texts.where(F.octet_length("text") >= LENGTH).select("uid", "text").mapInArrow(_deal, _STRETCH)
    line = Window.partitionBy("key", "done").orderBy("text", "uid", "start")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = dealt.withColumn("again", F.col("done") | F.coalesce(F.lag("text").over(line) == F.col("text"), F.lit(False)))
    seen = seen.withColumn("mixed", F.first("text").over(whole) != F.last("text").over(whole)).withColumn("many", F.count_if(~F.col("again")).over(whole))
    seen = cut(seen.where("again or mixed").select("key", "uid", "start", "windows", "done", "again", (F.col("many") > HOT).alias("hot")))
    at_once = seen.where("again").select("uid", "start", (F.col("start") + F.col("windows") + F.when(F.col("done"), 0).otherwise(LENGTH - 1)).alias("end"))
    wanted = seen.where("not again").groupBy("uid").agg(F.collect_list(F.struct("key", "start", "windows", "hot")).alias("wanted"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            first: dict[bytes, tuple[int, int]] = {}

            def out() -> pa.RecordBatch:
                k, u, s, t = zip(*rows, strict=True) if rows else ((),) * 4
                rows.clear()
                return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(u, pa.int64()), pa.array(s, pa.int64()), pa.array(t, pa.binary())], ["key", "uid", "start", "bytes"])

            for uid, text, want in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode()
                for w in want:
                    s, n = w["start"], w["windows"]
                    if not w["hot"]:
                        rows.append((w["key"], uid, s, raw[s : s + n + LENGTH - 1]))
                        continue
                    # each window by itself; of equal ones in the batch all but the first are known to repeat
                    for p in range(s, s + n):
                        t, me = raw[p : p + LENGTH], (uid, p)
                        other = first.setdefault(t, me)
                        if other != me:
                            first[t] = min(other, me)
                            rows.append((mixed_key(max(other, me)), *max(other, me), None))
                if len(rows) >= HELD // 20:
                    yield out()
                if len(first) >= HELD // 20:
                    rows += windows_of(first)
                    first.clear()
            rows += windows_of(first)
            yield out()

    gathered = by_uid(texts).join(wanted, "uid").select("uid", "text", "wanted").mapInArrow(gather, "key long, uid long, start long, bytes binary")
    shards = gathered.repartition("key").sortWithinPartitions("key", "uid", "start")
    return at_once.unionByName(shards.mapInArrow(_search, "uid long, start long, end long"))


def mixed_key(place: tuple[int, int]) -> int:
    """A key that spreads places over all tasks."""
    return int(mix(np.array([place[0] * 31 + place[1]], np.int64).view(np.uint64)).view(np.int64)[0])


def windows_of(first: dict[bytes, tuple[int, int]]) -> list[tuple[int, int, int, bytes]]:
    """Rows of single windows, dealt out by the hash of their own bytes."""
    if not first:
        return []
    data = np.frombuffer(b"".join(first), np.uint8)
    at = np.arange(0, len(data), LENGTH)
    keys = range_hash(prefix_hash(data), at, at + LENGTH).view(np.int64).tolist()
    return [(k, u, p, t) for k, (t, (u, p)) in zip(keys, first.items(), strict=True)]


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(uid, text, and the id) with a unique uid in the order of ids; whether uids are the ids.

    Where ids repeat or are null, distinct (id, text) pairs are numbered in order: null ids
    first, equal ids by the text's hash.
    """
    ids = docs.agg(F.count("*"), F.count(id_col), F.count_distinct(id_col)).first()
    if ids[0] == ids[1] == ids[2]:
        return docs.select(F.col(id_col).cast("long").alias("uid"), F.col(text_col).alias("text")), True
    keys = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("hash")).distinct()
    ordered = keys.repartitionByRange(F.col("id").asc_nulls_first(), "hash").sortWithinPartitions(F.col("id").asc_nulls_first(), "hash")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            cols = [*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(n, n + b.num_rows))]
            n += b.num_rows
            yield pa.RecordBatch.from_arrays(cols, ["id", "hash", "part", "seq"])

    keys = cut(ordered.mapInArrow(count, "id long, hash string, part int, seq long"))
    base = keys.groupBy("part").count().withColumn("base", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = keys.join(base.select("part", "base"), "part").select("id", "hash", (F.col("base") + F.col("seq")).alias("uid"))
    own = docs.select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).alias("text"))
    own = own.join(keys, own["_i"].eqNullSafe(keys["id"]) & (F.md5(F.coalesce("text", F.lit(""))) == keys["hash"]))
    return cut(own.groupBy("uid").agg(F.any_value("text").alias("text"), F.any_value("_i").alias("id"), F.count("*").alias("copies"))), False


def _finished(texts: DataFrame) -> DataFrame:
    """uid, the counts, the digest and the text that is left (null for a null text)."""
    ranges = covered_ranges(texts).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = by_uid(texts).join(ranges, "uid", "left").select("uid", "text", "ranges")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                kept, n_spans = raw, 0
                if ranges:
                    delta = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(delta, [r["start"] for r in ranges], 1)
                    np.add.at(delta, [r["end"] for r in ranges], -1)
                    gone = np.cumsum(delta)[:-1] > 0
                    n_spans = len(spans_of(gone)[0])
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if text is not None else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(finish, "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Every byte covered by a LENGTH-byte string that starts earlier too is removed.

    Earlier is a smaller id, or the same text further left; strings never cross texts and are judged
    on the input. Returns id, n_bytes, n_removed, n_spans (runs removed), kept_sha256 and, with
    text, `kept` (bytes that are no longer UTF-8 where a character was cut are dropped). A null
    text is empty. Rows of one id and text are one document and get the same answer; of one id
    and several texts the order is that of their hashes; null ids come first.
    """
    prepare(docs.sparkSession)
    texts, plain = numbered(docs, id_col, text_col)
    texts = texts.where("uid is not null")
    done = _finished(texts)
    cols = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    kind = dict(docs.dtypes)[id_col]
    if plain:
        return done.select(F.col("uid").cast(kind).alias(id_col), *cols)
    back = texts.select("uid", "id", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_"))
    return back.join(done, "uid").select(F.col("id").cast(kind).alias(id_col), *cols)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of `docs`, with all their columns, their text cut by remove_repeats; a column of
    text lengths, if there is one of that name, is brought up to date. A null text stays null."""
    rest = docs.withColumnsRenamed({c: f"_c{i}" for i, c in enumerate(docs.columns)})
    i, t = (f"_c{docs.columns.index(c)}" for c in (id_col, text_col))
    # repeated ids are told apart by the hash of their text
    unique = docs.agg(F.count("*") == F.count_distinct(id_col)).first()[0]
    if unique:
        cut_texts = remove_repeats(docs, id_col=id_col, text_col=text_col, with_text=True)
        joined = rest.drop(t).join(cut_texts.select(F.col(id_col).alias("_id"), F.col("kept").alias("_kept")), F.col(i) == F.col("_id"))
    else:
        texts, _ = numbered(docs, id_col, text_col)
        done = _finished(texts).select("uid", F.col("kept").alias("_kept"))
        own = texts.select("uid", F.col("id").alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_hash")).join(done, "uid")
        joined = rest.join(own, F.col(i).cast("long").eqNullSafe(F.col("_id")) & (F.md5(F.coalesce(t, F.lit(""))) == F.col("_hash")))
    kept = F.col("_kept") if unique else F.when(F.col(t).isNotNull(), F.col("_kept"))
    cols = []
    for k, c in enumerate(docs.columns):
        if c == text_col:
            cols.append(kept.alias(c))
        elif c == size_col:
            cols.append(F.when(F.col(f"_c{k}").isNotNull(), F.char_length(kept)).cast(dict(docs.dtypes)[c]).alias(c))
        else:
            cols.append(F.col(f"_c{k}").alias(c))
    return joined.select(*cols)
