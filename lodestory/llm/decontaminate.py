"""Benchmark decontamination with suffix arrays of the training text.

Training texts become sequences of word numbers (the benchmark's vocabulary; other words
never match). Each shard, a run of consecutive documents in one task, gets a suffix array over
the places where a benchmark passage could begin: those whose next few words begin a window of
the benchmark too (for longest matches: any of its suffixes). Every benchmark suffix is then
found in every shard by binary search, which gives its longest verbatim match and, for whole
windows, all their places. Nothing is shuffled; the benchmark travels in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestory.llm.shared import buffer_of, own_cache, prepare, ragged, slices, spans_of, words_of

WINDOW = 10
#: Words that must agree before a place enters a suffix array.
LEAD = 4
#: Text bytes of a shard, about.
SHARD_BYTES = 32 << 20
#: Benchmark bytes sent to the tasks at once; a larger benchmark goes in several blocks.
BLOCK_BYTES = 32 << 20


#: The words of a text as bytes, for the test of what hashes have found.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def plain_words(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode().lower())


def joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


class Probe:
    """The benchmark's suffixes, ready to be searched."""

    def __init__(self, items: list, texts: list[str | None], window: int, every: bool = False):
        data, offsets = buffer_of(pa.array(texts, pa.string()))
        words, first = words_of(data, offsets)
        self.items, self.window = items, window
        self.texts = [joined(plain_words(t)) for t in texts]
        self.vocab, ids = np.unique(words, return_inverse=True)
        self.seq = ids.astype(np.int64) + 1
        n = np.diff(first)
        self.item_of = np.repeat(np.arange(len(n)), n)
        self.left = np.repeat(first[1:], n) - np.arange(len(words))
        self.at = np.arange(len(words)) - np.repeat(first[:-1], n)
        self.longest = int(n.max()) if len(n) else 0
        # a window starts here: ten words follow, or the whole of a shorter item does
        self.size = np.where(self.left >= window, window, np.where((self.at == 0), self.left, 0))
        self.leads = {}
        for k in np.unique(np.minimum(self.size[self.size > 0], LEAD)).tolist():
            starts = np.flatnonzero(np.minimum(self.size, LEAD) == k)
            self.leads[k] = np.unique(_gram(self.seq, starts, k))
        if every:  # longest matches may begin at any suffix, not only where a window does
            self.leads[LEAD] = np.unique(_gram(self.seq, np.flatnonzero(self.left >= LEAD), LEAD))


def _gram(seq: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for o in range(k):
        h = (h ^ seq[starts + o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def suffix_order(seq: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The given places sorted by the `depth` words that follow, by ranks of doubled length.

    Only what follows a place up to its first unknown word (nothing matches beyond), united where
    such stretches overlap, is ranked, so memory grows with the shard whatever `depth` is.
    """
    if not len(starts):
        return starts
    unknown = np.append(np.flatnonzero(seq <= 0), len(seq) - 1)
    end = np.maximum.accumulate(np.minimum(starts + depth, unknown[np.searchsorted(unknown[:-1], starts)] + 1))
    first = np.flatnonzero(np.concatenate(([True], starts[1:] > end[:-1])))
    low = starts[first]
    near = ragged(low, end[np.append(first[1:], len(starts)) - 1] - low)
    rank = np.unique(seq[near], return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < depth:
        other = np.searchsorted(near, near + k)
        there = (other < len(near)) & (near[np.minimum(other, len(near) - 1)] == near + k)
        key = rank * (len(near) + 2) + np.where(there, rank[np.minimum(other, len(near) - 1)] + 1, 0)
        rank = np.unique(key, return_inverse=True)[1]
        if rank.max() == len(near) - 1:
            break
        k *= 2
    return starts[np.argsort(rank[np.searchsorted(near, starts)], kind="stable")]


def _below(seq: np.ndarray, place: np.ndarray, probe: np.ndarray, start: np.ndarray, size: np.ndarray, equal: bool) -> np.ndarray:
    """Whether each training suffix is below the probe's words (equal: or begins with them)."""
    out = np.full(len(place), equal)
    open_ = np.arange(len(place))
    for d in range(int(size.max()) if len(size) else 0):
        open_ = open_[size[open_] > d]
        if not len(open_):
            break
        a, b = seq[place[open_] + d], probe[start[open_] + d]
        out[open_[a < b]] = True
        out[open_[a > b]] = False
        open_ = open_[a == b]
    return out


def _bound(seq: np.ndarray, order: np.ndarray, probe: np.ndarray, start: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(order))
    while len(act := np.flatnonzero(lo < hi)):
        mid = (lo[act] + hi[act]) // 2
        less = _below(seq, order[mid], probe, start[act], size[act], upper)
        lo[act[less]] = mid[less] + 1
        hi[act[~less]] = mid[~less]
    return lo


def search_shard(seq: np.ndarray, order: np.ndarray, p: Probe) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, sizes, items) of all windows found, then for every probe suffix the length of its
    longest match in the shard and a place that has it (-1 if none)."""
    every = np.arange(len(p.seq))
    lower = _bound(seq, order, p.seq, every, p.left, False)
    best, where = np.zeros(len(every), np.int64), np.full(len(every), -1)
    for side in (lower - 1, lower):
        ok = np.flatnonzero((side >= 0) & (side < len(order)))
        length = np.zeros(len(ok), np.int64)
        live = np.arange(len(ok))
        while len(live := live[length[live] < p.left[ok[live]]]):
            same = seq[order[side[ok[live]]] + length[live]] == p.seq[ok[live] + length[live]]
            live = live[same]
            length[live] += 1
        better = length > best[ok]
        best[ok[better]], where[ok[better]] = length[better], order[side[ok[better]]]
    win = np.flatnonzero((p.size > 0) & (best >= p.size))
    lo = _bound(seq, order, p.seq, win, p.size[win], False)
    hi = _bound(seq, order, p.seq, win, p.size[win], True)
    n = hi - lo
    return order[ragged(lo, n)], np.repeat(p.size[win], n), np.repeat(p.item_of[win], n), best, where


class Shard:
    """Hashed words of consecutive texts, searched for one block of the benchmark after another."""

    def __init__(self):
        self.words, self.counts, self.bytes = [], [], 0

    def add(self, arr: pa.Array) -> None:
        data, offsets = buffer_of(arr)
        self.bytes += len(data)
        for lo, hi in slices(offsets):
            words, first = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            self.words.append(words)
            self.counts.append(np.diff(first))

    def close(self) -> None:
        """All words, one separator's place after each text, and each text's first place."""
        self.n = np.concatenate([*self.counts, np.zeros(0, np.int64)])
        self.flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        self.edge = np.concatenate(([0], np.cumsum(self.n + 1)))
        self.place = np.arange(len(self.flat)) + np.repeat(np.arange(len(self.n)), self.n)

    def search(self, p: Probe) -> tuple:
        """What search_shard finds in the shard's suffix array for one block."""
        seq = np.full(self.edge[-1] + max(p.longest, LEAD) + 1, -1, np.int64)
        k = np.searchsorted(p.vocab, self.flat)
        known = p.vocab[np.minimum(k, len(p.vocab) - 1)] == self.flat if len(p.vocab) else np.zeros(len(self.flat), bool)
        seq[self.place] = np.where(known, k + 1, 0)
        use = np.zeros(len(seq), bool)
        for size, grams in p.leads.items():
            ok = self.place[known]
            for o in range(1, size):
                ok = ok[seq[ok + o] > 0]
            h = _gram(seq, ok, size)
            use[ok[grams[np.minimum(np.searchsorted(grams, h), len(grams) - 1)] == h]] = True
        order = suffix_order(seq, np.flatnonzero(use), max(p.longest, 1))
        return search_shard(seq, order, p)


def confirmed(held: list[pa.RecordBatch], shard: Shard, p: Probe, places: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which of the found windows are in their items byte by byte: words are searched by 64-bit hashes, and
    different words can have equal ones. Only texts with found windows are cut into words again."""
    doc = np.searchsorted(shard.edge, places, "right") - 1
    first = np.concatenate(([0], np.cumsum([b.num_rows for b in held])))
    words: dict[int, list[bytes]] = {}
    out = np.zeros(len(places), bool)
    for k, (d, place, size, item) in enumerate(zip(doc.tolist(), (places - shard.edge[doc]).tolist(), sizes.tolist(), items.tolist(), strict=True)):
        if d not in words:
            b = int(np.searchsorted(first, d, "right")) - 1
            words[d] = plain_words(held[b].column(1)[d - int(first[b])].as_py())
        out[k] = joined(words[d][place : place + size]) in p.texts[item]
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of bounded size; a block is all that the driver holds at once."""
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(item_col, text_col)
    total = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64(item_col), F.lit(n)) == k)
        got = sorted(part.collect(), key=lambda r: (str(r[0]), r[1]))
        yield [r[0] for r in got], [r[1] for r in got]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Where benchmark windows occur in documents.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. A window
    is `window` consecutive words of an item, or the whole of a shorter one. Returns per row:
    id, n_words, n_hit (words inside any occurrence), n_items, items (ids as strings, sorted as
    strings), spans (first and end word of each hit run), contaminated, and the columns named in
    `keep`. A null text has no words; items with null id or text are left out; repeated rows
    are judged alike; empty tables give no rows or no hits.
    """
    spark = prepare(docs.sparkSession)
    keep = keep or []
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *keep)
    kept = "".join(f", `{c}` {t}" for c, t in docs.select(*keep).dtypes)
    blocks = _probes(spark, benchmark, item_col, item_text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("passages")
        for held, shard in _shards(batches):
            delta = np.zeros(shard.edge[-1] + 1, np.int64)
            pairs: set[tuple[int, str]] = set()
            for p in _each(blocks):
                places, sizes, items, _, _ = shard.search(p)
                ok = confirmed(held, shard, p, places, sizes, items)
                places, sizes, items = places[ok], sizes[ok], items[ok]
                np.add.at(delta, places, 1)
                np.add.at(delta, places + sizes, -1)
                pair = np.unique((np.searchsorted(shard.edge, places, "right") - 1) * max(1, len(p.items)) + items)
                pairs.update((int(x) // len(p.items), p.items[int(x) % len(p.items)]) for x in pair)
            s, e = spans_of(np.cumsum(delta)[:-1] > 0)
            doc = np.searchsorted(shard.edge, s, "right") - 1
            s, e = s - shard.edge[doc], e - shard.edge[doc]
            found = sorted(pairs)
            pdoc, names = np.array([d for d, _ in found], np.int64), [x for _, x in found]
            i = 0
            for b in held:
                lo, hi = i, i + b.num_rows
                i = hi
                (sl, sh), (pl, ph) = np.searchsorted(doc, [lo, hi]), np.searchsorted(pdoc, [lo, hi])
                at = pa.array(np.searchsorted(doc[sl:sh], np.arange(lo, hi + 1)).astype(np.int32))
                pat = pa.array(np.searchsorted(pdoc[pl:ph], np.arange(lo, hi + 1)).astype(np.int32))
                spans = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(s[sl:sh]), pa.array(e[sl:sh])], ["s", "e"]))
                cols = [b.column(0), pa.array(shard.n[lo:hi].astype(np.int64)), spans, pa.ListArray.from_arrays(pat, pa.array(names[pl:ph], pa.string()))]
                yield pa.RecordBatch.from_arrays([*cols, *b.columns[2:]], ["_id", "n_words", "spans", "items", *keep])

    out = base.mapInArrow(run, f"_id {dict(docs.dtypes)[id_col]}, n_words long, spans array<struct<s:long,e:long>>, items array<string>{kept}")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    items = F.array_sort(F.array_distinct("items"))
    return out.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), "spans", (n_hit > 0).alias("contaminated"), *keep)


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAD, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The longest verbatim match of every benchmark suffix that has one of `least` (LEAD or more)
    words: item, item_word, n_words, and one document with its first word of the match.

    Each shard answers for itself; Spark keeps the longest (of equals the smallest id and place).
    """
    spark = prepare(docs.sparkSession)
    blocks = _probes(spark, benchmark, item_col, item_text_col, window, every=True)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("passages")
        for held, shard in _shards(batches):
            ids = pa.concat_arrays([b.column(0) for b in held])
            for p in _each(blocks):
                _, _, _, best, where = shard.search(p)
                k = np.flatnonzero(best >= max(least, LEAD))
                k = k[confirmed(held, shard, p, where[k], best[k], p.item_of[k])]
                doc = np.searchsorted(shard.edge, where[k], "right") - 1
                cols = [pa.array([p.items[i] for i in p.item_of[k]], pa.string()), pa.array(p.at[k]), pa.array(best[k]), ids.take(pa.array(doc)), pa.array(where[k] - shard.edge[doc])]
                yield pa.RecordBatch.from_arrays(cols, ["item", "item_word", "n_words", "doc", "doc_word"])

    found = docs.select(id_col, text_col).mapInArrow(run, f"item string, item_word long, n_words long, doc {kind}, doc_word long")
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc", "doc_word")).alias("b")
    return found.groupBy("item", "item_word").agg(best).select("item", "item_word", (-F.col("b.n")).alias("n_words"), F.col("b.doc").alias(id_col), F.col("b.doc_word").alias("doc_word"))


def _probes(spark, benchmark: DataFrame, item_col: str, text_col: str, window: int, every: bool = False) -> list:
    """Broadcast blocks of the benchmark, BLOCK_BYTES of text each at most (about)."""
    return [spark.sparkContext.broadcast(Probe([str(i) for i in items], texts, window, every)) for items, texts in _blocks(benchmark, item_col, text_col)]


def _each(blocks: list) -> Iterator[Probe]:
    """The blocks one by one; of several only one stays in a worker's memory."""
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            b.__dict__.pop("_value", None)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], Shard]]:
    held, shard = [], Shard()
    for b in batches:
        held.append(b)
        shard.add(b.column(1))
        if shard.bytes >= SHARD_BYTES:
            shard.close()
            yield held, shard
            held, shard = [], Shard()
    if held:
        shard.close()
        yield held, shard


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no benchmark window."""
    rest = [c for c in docs.columns if c != id_col]
    renamed = docs.select(F.col(id_col), F.col(text_col).alias("_whole"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)])
    kept = [f"_c{i}" for i in range(len(rest))]
    out = benchmark_hits(renamed, benchmark, window=window, id_col=id_col, text_col="_whole", keep=kept).where(~F.col("contaminated"))
    return out.select(*[F.col(id_col) if c == id_col else F.col(f"_c{rest.index(c)}").alias(c) for c in docs.columns])
