"""The text operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import lodestory.llm.decontaminate as D
import lodestory.llm.suffix_dedup as S
from lodestory.llm import queries as Q
from lodestory.llm.encoding import ChunkEncoder
from lodestory.llm.induced import permuted_prefixes, suffix_array
from lodestory.llm.language_id import identify_language, keep_identified, train_language_model
from lodestory.llm.near_dedup import inverse_frequencies, keep_one_of_each, near_duplicate_classes, shingles, weighted, weighted_jaccard
from lodestory.llm.nearest import nearest_neighbours
from lodestory.llm.packing import pack_documents
from lodestory.llm.shared import buffer_of, held_out, scratch
from lodestory.llm.token_counts import PrefixCounter, longest_within, prefix_token_counts, tokens_before
from lodestory.llm.token_store import pack_ids, read_token_store, unpack_ids, write_token_store
from lodestory.llm.toxicity import score_toxicity, train_toxicity_model
from lodestory.llm.url_trust import judge_urls, personalised_pagerank

SF = "/root/testdata/sf0.001"
WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "don't we'll <|endoftext|> x", "Ébène l’été ﬁ Σας ΣΑΣ e\u0301 ½ ²3 \u200b a\x1cb", "'re'l 'rex !!'s", "日本語 🙂🙂", "a\n\n b\t c  ", "x" * 5000]


def docs(spark, rows=None):
    """Nulls, empties, repeats, ties and clashing columns."""
    x = "abcdefghij" * 30
    rows = rows or [(2, x), (1, x[:150]), (None, None), (3, ""), (2, x), (None, x[:120]), (2, "q" * 250), (7, "one two three four five six seven"), (8, "one two three four five six seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("n_tokens", F.lit("x")).withColumn("score", F.lit(1)).withColumn("spans", F.lit("y"))


# tokens


@pytest.mark.parametrize("path,spaces", [(WORD, False), (BYTE, True)])
def test_chunks_encode_as_the_library_does(path, spaces):
    enc, tok = ChunkEncoder(path, spaces), Tokenizer.from_file(path)
    for _ in range(2):
        ids, n = enc.encode(ODD)
        want = [tok.encode(t, add_special_tokens=False).ids for t in ODD]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_every_prefix_is_counted(spark):
    c, tok = PrefixCounter(WORD), Tokenizer.from_file(WORD)
    for t in ["hello worlds don't stop", "éèê naïve, (2024)!!", "'ll 'lx 're 'rex we've"]:
        table = c.table(t)
        assert table.tolist() == [len(tok.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert tokens_before(table, 5) == table[5] and table[longest_within(table, 3)] <= 3
    for t in ODD:
        assert c.table(t)[-1] == len(tok.encode(t, add_special_tokens=False).ids)
    out = prefix_token_counts(docs(spark), WORD, keep_table=True).collect()
    assert len(out) == 9 and all(r["prefix_tokens"][-1] == r["n_tokens"] for r in out)
    assert prefix_token_counts(docs(spark).limit(0), WORD).count() == 0


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), rng.integers(0, 90_000, 5001).astype(np.uint32), (rng.zipf(1.2, 9999) % 300_000).astype(np.uint32)):
        assert np.array_equal(unpack_ids(*pack_ids(ids), len(ids)), ids)


def test_token_store_round_trip(spark):
    tok, path = Tokenizer.from_file(WORD), scratch(spark)
    df = docs(spark)
    write_token_store(df, path, WORD, spaces=False, block_ids=40)
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in read_token_store(spark, path).collect())
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in df.collect()))
    at, want = 0, []
    for ok, i, _, t in rows:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want.append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), i if ok else None))
        at += len(ids)
    assert got == sorted(want, key=lambda w: w[0])
    empty = scratch(spark)
    write_token_store(df.limit(0), empty, WORD, spaces=False)
    assert read_token_store(spark, empty).count() == 0


def check_packing(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limit
    return len(by)


@pytest.mark.parametrize("limit", [64, 2048])
def test_packing(spark, limit):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack_documents(df, BYTE, limit=limit).collect()
    tok = Tokenizer.from_file(BYTE)
    want = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in df.collect()}
    pieces = {}
    for r in rows:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for d, p in pieces.items():
        p.sort()
        assert sum(n for *_, n in p) == len(want[d]) and all(n == limit for *_, n in p[1:])
        assert len(want[d]) > limit or len(p) == 1
    used = check_packing(rows, limit)
    bins = []  # best fit, one piece after another
    for n in sorted((r["length"] for r in rows), reverse=True):
        fit = [g for g in bins if g >= n]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - n)
        else:
            bins.append(limit - n)
    assert used <= 1.02 * len(bins) + 1


def test_packing_of_many_tiny_and_odd_rows(spark):
    rows = pack_documents(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")), BYTE, limit=64).collect()
    assert len(rows) == 3000 and check_packing(rows, 64) <= -(-9000 // 63) + 1
    assert len(pack_documents(docs(spark), BYTE).collect()) == 9
    assert pack_documents(docs(spark).limit(0), BYTE).count() == 0


# models


def test_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = train_language_model(df)
    out = identify_language(df, m).join(df.select("doc_id", "lang", held_out("doc_id").alias("h")), "doc_id").where("h").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.96 and out.score.between(0, 1).all()
    assert keep_identified(df, m).count() >= 0.99 * df.count()
    odd = identify_language(docs(spark, [(1, None), (2, ""), (3, "12 !!"), (None, "the and of")]), m).collect()
    assert [r["lang_pred"] for r in odd[:3]] == ["und"] * 3 and odd[3]["lang_pred"] != "und"
    assert train_language_model(docs(spark)) is None
    assert {r["lang_pred"] for r in identify_language(docs(spark), None).collect()} == {"und"}


def test_language_never_learns_from_held_out_rows(spark):
    df = spark.createDataFrame([(i, "zz yy xx " * 9, "aa") for i in range(60)], "doc_id long, text string, lang string")
    bad = df.withColumn("lang", F.when(held_out("doc_id"), "wrong").otherwise(F.col("lang")))
    assert train_language_model(bad).langs == ["aa"]


def test_toxicity(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = train_toxicity_model(df, labels, train_language_model(df))
    out = score_toxicity(df, m).join(labels, "doc_id").where(held_out("doc_id")).toPandas()
    hit = (out.predicted == 1) & (out.toxic == 1)
    assert hit.sum() / (out.predicted == 1).sum() > 0.85 and hit.sum() / (out.toxic == 1).sum() > 0.85
    assert ((out.score >= 0.3) == (out.predicted == 1)).all()
    odd = score_toxicity(docs(spark), m).collect()
    assert len(odd) == 9 and all(0 <= r["score"] <= 1 for r in odd)
    assert train_toxicity_model(df.limit(0), labels, None) is None
    assert {r["score"] for r in score_toxicity(docs(spark), None).collect()} == {0.0}


# windows, suffixes, neighbours

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(rows, items, window=10):
    low = lambda t: WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = low(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[j : j + k]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, found = low(t), set()
        hit = [False] * len(w)
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if got := wins.get(tuple(w[j : j + k])):
                    found |= got
                    hit[j : j + k] = [True] * k
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [32 << 20, 2000])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    got = sorted(map(tuple, Q.op2_decontamination(spark, SF).collect()), key=str)
    rows, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert got == brute_hits([(r["doc_id"], r["text"]) for r in rows], [(r["item_id"], r["text"]) for r in items])


def test_decontamination_edges(spark):
    rows = [(1, "the A b c the"), (2, None), (None, "b c"), (4, "a b c d e f g h i j k l m"), (4, ""), (4, "")]
    items = [(1, "The"), (2, "b c"), (3, None), (4, "B c d e f g h i j k l zz"), (5, ""), (None, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.benchmark_hits(docs(spark, rows), bench)
    digest = F.sha2(F.array_join("items", ","), 256)
    got = sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated").collect()), key=str)
    assert got == brute_hits(rows, [i for i in items if i[0] is not None])
    assert D.benchmark_hits(docs(spark).limit(0), bench).count() == 0
    assert not D.benchmark_hits(docs(spark, rows), bench.limit(0)).where("contaminated").count()
    kept = D.remove_contaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns and kept.count() == 3
    best = {(r["item"], r["item_word"]): (r["n_words"], r["doc_id"], r["doc_word"]) for r in D.longest_matches(docs(spark, rows), bench).collect()}
    assert best["4", 0] == (11, 4, 1)


def test_longest_matches_of_all_suffixes(spark):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join("abc"[k] for k in rng.integers(0, 3, n))
    rows = [(k, say(40)) for k in range(6)] + [(9, "x a b c d e f g h i j k l"), (10, "q h i j k l q")]
    items = [(k, say(n)) for k, n in enumerate((3, 4, 7, 12, 25))] + [(7, "y a b e f g h i j k l"), (8, "c d e f g h i j k l m")]
    found = D.longest_matches(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    texts = {d: t.split() for d, t in rows}
    want = {}
    for i, t in items:
        w = t.split()
        for a in range(len(w)):
            n = max(k for k in range(len(w) - a + 1) if any(w[a : a + k] == x[j : j + k] for x in texts.values() for j in range(len(x))))
            if n >= 4:
                want[str(i), a] = n
    assert {(r["item"], r["item_word"]): r["n_words"] for r in found} == want
    for r in found:
        w, at, n = dict(items)[int(r["item"])].split(), r["doc_word"], r["n_words"]
        assert texts[r["doc_id"]][at : at + n] == w[r["item_word"] : r["item_word"] + n]


@pytest.mark.parametrize("sigma", [2, 4, 200])
def test_suffix_array(sigma):
    rng = np.random.default_rng(sigma)
    for _ in range(60):
        t = np.append(rng.integers(1, sigma + 1, rng.integers(1, 60)), 0).astype(np.int64)
        assert suffix_array(t, sigma + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_permuted_prefixes():
    raw = np.frombuffer(b"abcabcabdabcabcabcabd" * 30 + b"\0" * 9, np.uint8)
    t = np.append(raw[:-9].astype(np.int64), 0)
    order = suffix_array(t, 256)
    order = order[order < len(t) - 1 - 100]
    got = permuted_prefixes(raw, order, 100)
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while k < 100 and raw[a + k] == raw[b + k]:
            k += 1
        assert got[b] == k


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot,held", [(20_000, 2_000_000), (2, 500)])
def test_repeats(spark, monkeypatch, hot, held):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "HELD", held)
    got = {r[0]: tuple(r)[1:] for r in Q.op5_suffix_dedup(spark, SF).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == brute_repeats(rows)


def test_repeats_edges(spark):
    out = S.without_repeats(docs(spark))
    assert out.columns == docs(spark).columns and out.count() == 9
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert (2, "q") in got and (None, None) in got and (None, "abcdefghij") in got and got.count((2, "")) == 2
    assert S.remove_repeats(docs(spark).limit(0)).count() == 0
    runs = [(1, "a" * 20_000), (2, "ab" * 9000), (3, "ñ" * 300)]
    assert {r[0]: tuple(r)[1:] for r in S.remove_repeats(docs(spark, runs)).collect()} == brute_repeats(runs)


def test_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3000)
    rng = np.random.default_rng(4)
    a = "".join(rng.choice(list("abcdefgh"), 2_000_000 // 100)) * 60
    rows = [(5, a), (6, a[777:9000])]
    assert {r[0]: tuple(r)[1:] for r in S.remove_repeats(docs(spark, rows)).collect()} == brute_repeats(rows)


def brute_classes(spark, df, similarity=0.8):
    idf = inverse_frequencies(df)
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()))
    data, offsets = buffer_of(pa.array([t for _, t in rows]))
    sets = [weighted(h, idf) for h in shingles(data, offsets)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and weighted_jaccard(sets[i], sets[j]) >= similarity:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {d: rows[k][0] for (d, _), k in zip(rows, label, strict=True)}


def test_near_duplicates(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r["doc_id"]: r["class_id"] for r in Q.op9_near_duplicates(spark, SF).collect()} == brute_classes(spark, df)


def test_near_duplicate_chains_and_edges(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[: 300 - 12 * i] + [f"v{i}_{k}" for k in range(12 * i)])) for i in range(4)]
    rows += [(100 + i, " ".join(rng.choice(base, 200))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicate_classes(df).collect()} == brute_classes(spark, df)
    odd = {(r["doc_id"], r["class_id"]) for r in near_duplicate_classes(docs(spark)).collect()}
    assert {(7, 7), (8, 7), (3, 3), (None, None)} <= odd
    kept = keep_one_of_each(docs(spark))
    assert kept.columns == docs(spark).columns and 8 not in {r["doc_id"] for r in kept.collect()}
    assert near_duplicate_classes(docs(spark).limit(0)).count() == 0


def test_nearest(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    x, ids = np.stack(df.embedding.values).astype(float), df.vec_id.values
    got = Q.op3_nearest_neighbours(spark, "/root/testdata/sf0.1").toPandas()
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        near = got[got.query_id == q].sort_values("rank")
        assert np.allclose([d[ids == v][0] for v in near.vec_id], near.score) and near.score.is_monotonic_increasing
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(near.vec_id))
    assert hit >= 0.95 * 10 * (ids % 100 == 0).sum()


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (100, [1.0, 0.0]), (None, [1.0, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 3.0]), (1, [0.0, 1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest_neighbours(df).collect())
    assert got == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert nearest_neighbours(df.limit(0)).count() == 0


def test_pagerank_against_numpy(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 1), ("d", "c", 3), ("c", "e", 1)]
    got = {r["host"]: r["rank"] for r in personalised_pagerank(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("a", 1), ("d", 3)], "host string, weight long"), rounds=8).collect()}
    names = "abcde"
    m = np.zeros((5, 5))
    for s, d, n in edges:
        m[names.index(d), names.index(s)] = n
    m = np.divide(m, m.sum(0), where=m.sum(0) > 0, out=np.zeros_like(m))
    start = np.array([0.25, 0, 0, 0.75, 0])
    r = start.copy()
    for _ in range(8):
        moved = 0.85 * m @ r
        r = moved + start * (1 - moved.sum())
    assert all(abs(got.get(n, 0) - r[k]) < 1e-12 for k, n in enumerate(names))


def test_url_rules(spark):
    rows = [(1, "http://A.example.com/en/71", ""), (2, None, None), (3, "x", '<a href="//q.net">'), (4, "q://x.NET/de/1?u", None), (5, "http://z.org?x=/es/", ""), (5, "http://b.org/es/#", "<A class=x HREF=https://x.net/>"), (6, "http://y.example.net/de/8", ""), (7, "http://notexample.com/en/7", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "a.example.com", "/en/71", "example.com/en/7", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "x.net", "/de/1", "net/de/", "allow"), (5, "z.org", "", None, "allow"), (5, "b.org", "/es/", "org/es/", "block"), (6, "y.example.net", "/de/8", "example.net/de/8", "block"), (7, "notexample.com", "/en/7", "com/en/", "block")],
        key=str,
    )
    assert judge_urls(df.limit(0)).count() == 0


def test_distrust_spreads(spark):
    rows = [(1, "http://bad.com/en/1", ""), (2, "http://friend.biz/x", '<a href="http://bad.com/">'), (3, "http://good.net/de/1", '<a href="http://kin.biz/">'), (4, "http://kin.biz/", "")]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_pagerank_converges(spark):
    names = [f"h{k}" for k in range(14)]
    edges = [(a, b, 1) for a, b in zip(names, names[1:], strict=False)] + [("h3", "h2", 2), ("h13", "h12", 1), ("q", "h0", 1)]
    got = {r["host"]: r["rank"] for r in personalised_pagerank(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([("h0", 1), ("h3", 3)], "host string, weight long")).collect()}
    names.append("q")
    m = np.zeros((15, 15))
    for s, d, n in edges:
        m[names.index(d), names.index(s)] = n
    m = np.divide(m, m.sum(0), where=m.sum(0) > 0, out=np.zeros_like(m))
    start = np.zeros(15)
    start[[0, 3]] = 0.25, 0.75
    r = start.copy()
    for _ in range(400):
        moved = 0.85 * m @ r
        r = moved + start * (1 - moved.sum())
    assert sum(abs(got.get(n, 0) - r[k]) for k, n in enumerate(names)) < 3e-6


def test_distrust_reaches_far(spark):
    rows = [(0, "http://bad.com/en/1", "")] + [(k, f"http://h{k}.biz/", f'<a href="http://{"bad.com" if k == 1 else f"h{k - 1}.biz"}/">') for k in range(1, 13)]
    got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"block"} and len(got) == 13
