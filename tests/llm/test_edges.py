"""Long texts, hot groups, several shards and plain versions of the text operators."""

import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import lodestory.llm.decontaminate as D
import lodestory.llm.nearest as N
import lodestory.llm.suffix_dedup as S
import lodestory.llm.toxicity as T
from lodestory.llm import queries as Q
from lodestory.llm.encoding import ChunkEncoder
from lodestory.llm.induced import suffix_array
from lodestory.llm.language_id import identify_language, keep_identified, no_language, split_rows, text_logits, train_language_model
from lodestory.llm.near_dedup import BANDS, ROWS, band_hashes, inverse_frequencies, keep_one_of_each, shingles, weighted, weighted_jaccard
from lodestory.llm.packing import best_fit, pack_documents
from lodestory.llm.shared import buffer_of, held_out, scratch, words_of
from lodestory.llm.token_counts import LONG, PrefixCounter
from lodestory.llm.token_store import read_token_store, write_token_store
from lodestory.llm.url_trust import KIN, RULES, converged_pagerank, judge_urls
from tests.llm.test_operators import BYTE, SF, WORD, brute_hits, brute_repeats, check_packing, docs

MID = "/root/testdata/sf0.01"


# tokens


@pytest.mark.parametrize("n", [LONG - 1, LONG + 1, 700])
def test_prefixes_of_long_words(n):
    rng = np.random.default_rng(n)
    c, tok = PrefixCounter(WORD), Tokenizer.from_file(WORD)
    kinds = [list("abcdefghijklmnopqrstuvwxyz"), list("etaoin"), ["é", "ß", "ö", "e"], [chr(k) for k in range(0x4E00, 0x4F00)], list("!?.-#")]
    for letters in kinds:
        t = "".join(rng.choice(letters, n))
        table = c.table(t)
        for i in [*range(0, n, 41), n]:
            assert table[i] == len(tok.encode(t[:i], add_special_tokens=False).ids)


def test_counts_of_huge_words_need_little_memory():
    c, tok = PrefixCounter(WORD), Tokenizer.from_file(WORD)
    rng = np.random.default_rng(1)
    texts = ["x" * 150_000, "".join(rng.choice(list("etaoinsh"), 150_000)), "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 50_000)))]
    tracemalloc.start()
    got = [int(c.table(t)[-1]) for t in texts]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts] and peak < 150 << 20


def test_counts_of_all_documents(spark):
    tok = Tokenizer.from_file(WORD)
    want = {r["doc_id"]: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    rows = Q.op4_token_counts(spark, MID).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)


def test_chunks_of_odd_and_plain_texts_mixed():
    rng = np.random.default_rng(5)
    parts = ["plain words here", "tab\tand  spaces ", "", " ", "naïve façade", "日本", "a<|endoftext|>b", "<|", "x y", "\r\n", "ÀÉ ıŁ", "bell\x07", "…–€"]
    texts = [" ".join(rng.choice(parts, rng.integers(0, 6))) for _ in range(300)] + [None]
    for path, spaces in ((WORD, False), (BYTE, True)):
        tok, enc = Tokenizer.from_file(path), ChunkEncoder(path, spaces)
        ids, n = enc.encode(pa.array(texts, pa.string()).slice(3))
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts[3:]]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_texts_of_megabytes(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(4000)]
    long = " ".join(rng.choice(words, 400_000))
    df = docs(spark, [(1, long), (2, "short one"), (3, None)])
    tok = Tokenizer.from_file(BYTE)
    want = [*tok.encode(long, add_special_tokens=False).ids, 0]
    rows = sorted((r for r in pack_documents(df, BYTE).collect() if r["doc_id"] == 1), key=lambda r: r["piece"])
    assert sum(r["length"] for r in rows) == len(want) and [r["length"] for r in rows[1:]] == [2048] * (len(rows) - 1)
    for r in (rows[0], rows[len(rows) // 2], rows[-1]):
        assert zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    path, tok = scratch(spark), Tokenizer.from_file(WORD)
    write_token_store(df, path, WORD, spaces=False)
    got = {r["doc_id"]: r for r in read_token_store(spark, path).collect()}
    ids = [*tok.encode(long, add_special_tokens=False).ids, 1]
    assert got[1]["ids"] == ids and got[2]["start"] == len(ids) and got[3]["n_tokens"] == 1


def test_packing_of_one_size_and_of_halves(spark):
    rng = np.random.default_rng(7)
    texts = ["a " * int(n) for n in [*([16] * 900), *rng.integers(1, 62, 300), *([31] * 200)]]
    rows = pack_documents(docs(spark, list(enumerate(texts))), BYTE, limit=64).collect()
    bins = []  # best fit, one piece after another
    for n in sorted((r["length"] for r in rows), reverse=True):
        fit = [g for g in bins if g >= n]
        bins.append((min(fit) if fit else 64) - n)
        if fit:
            bins.remove(min(fit))
    assert len(rows) == 1400 and check_packing(rows, 64) <= 1.03 * len(bins)


def test_packing_takes_few_rounds(spark):
    sizes = np.random.default_rng(0).gamma(1.2, 400, 4000).astype(int).clip(1, 2048)
    pieces = spark.createDataFrame([(k, int(n)) for k, n in enumerate(sizes)], "pid long, length long")
    placed = best_fit(pieces, limit=2048).collect()
    assert len(placed) == 4000 and max(r["round"] for r in placed) <= 5
    used = {}
    for r in placed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= 1.005 * sum(used.values()) / 2048 + 60


# decontamination


def test_long_items_and_many_copies(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 500, 4000)]
    item = " ".join(words)
    rows = [(k, f"x{k} " + item + f" y{k}") for k in range(8)] + [(9, " ".join(words[100:109])), (10, " ".join(words[100:110]))]
    probe = D.Probe(["1"], [item], 10)
    shard = D.Shard()
    shard.add(pa.array([t for _, t in rows]))
    shard.close()
    tracemalloc.start()
    places, sizes, items, best, _ = shard.search(probe)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and best[0] == 4000
    got = D.benchmark_hits(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    digest = F.sha2(F.array_join("items", ","), 256)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated").collect()), key=str) == brute_hits(rows, [(1, item)])


# suffix arrays


@pytest.mark.parametrize("block", [[1, 2], [2, 1, 1], [3, 1, 2, 1, 3, 1, 1], [5]])
def test_suffix_arrays_of_periods_and_runs(block):
    rng = np.random.default_rng(sum(block))
    t = np.concatenate([np.tile(block, 40), rng.integers(1, 6, 30), np.tile(block, 25), np.full(30, block[0]), [0]]).astype(np.int64)
    assert suffix_array(t, 7).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_array_with_as_many_letters_as_places():
    t = np.append(np.random.default_rng(0).permutation(5000) + 1, 0)
    assert suffix_array(t, 5001).tolist() == sorted(range(len(t)), key=lambda i: t[i])


def test_one_passage_in_many_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    monkeypatch.setattr(S, "SHARD_BYTES", 2000)
    rng = np.random.default_rng(6)
    say = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = say(230)
    rows = [(k, say(int(rng.integers(0, 80))) + passage[int(rng.integers(0, 30)) :] + say(int(rng.integers(0, 90)))) for k in range(60)]
    assert {r[0]: tuple(r)[1:] for r in S.remove_repeats(docs(spark, rows)).collect()} == brute_repeats(rows)


# near copies


def test_samples_meet_as_often_as_texts_are_alike():
    rng = np.random.default_rng(8)
    none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for share in (0.5, 0.8, 0.9):
        keep = a[: int(share * 400)]
        b = np.concatenate([keep, rng.integers(0, 1 << 63, 400 - len(keep)).astype(np.uint64)])
        want = weighted_jaccard(weighted(a, none), weighted(b, none))
        met = 0
        for salt in range(60):  # other hashes, other draws
            x, y = (weighted(h * np.uint64(2 * salt + 1) + np.uint64(salt), none) for h in (a, b))
            met += (band_hashes(*x) == band_hashes(*y)).sum()
        rate = met / (60 * BANDS)
        assert abs(rate - want**ROWS) < 0.06


def test_frequent_shingles_are_counted_exactly(spark):
    texts = [f"common words that all of us share here number {k % 7}" for k in range(50)] + [f"u{k} v{k} w{k} x{k} y{k}" for k in range(50)]
    df = docs(spark, list(enumerate(texts)))
    keys, value = inverse_frequencies(df)
    df_of = {}
    for t in texts:
        data, offsets = buffer_of(pa.array([t]))
        for h in set(next(iter(shingles(data, offsets))).tolist()):
            df_of[h] = df_of.get(h, 0) + 1
    want = {h: 1 - 0.2 * np.log(n / 2) / np.log(100 / 2) for h, n in df_of.items() if n >= 2}
    assert dict(zip(keys.tolist(), np.round(value, 5).tolist(), strict=True)) == pytest.approx({h: round(v, 5) for h, v in want.items()}, abs=2e-5)


def test_one_of_each_keeps_clashing_columns(spark):
    df = docs(spark).withColumn("_rank", F.lit(9)).withColumn("_head", F.lit("h")).withColumn("_c0", F.lit("c"))
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns and {(r["_rank"], r["_head"], r["_c0"]) for r in kept.collect()} == {(9, "h", "c")}


# neighbours


@pytest.mark.parametrize("shard", [37, 4000])
def test_neighbours_over_several_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(N, "SHARD_ROWS", shard)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(400, 8)), 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in N.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=40).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 400, 40):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(400), d))[:5]
        assert [k for k, *_ in sorted(got[q])] == [1, 2, 3, 4, 5] and np.allclose([s for *_, s in sorted(got[q])], [d[v] for _, v, _ in sorted(got[q])])
        hit += len(set(best) & {v for _, v, _ in got[q]})
    assert len(got) == 10 and hit >= 45


# models


def test_no_language_is_rejected(spark):
    df = spark.read.parquet(f"{MID}/documents.parquet")
    m = train_language_model(df)
    texts = [r["text"] for r in df.where(held_out("doc_id") & (F.length("text") > 300)).collect()]
    made = [no_language(t) for t in texts]
    other = ["Это предложение написано по-русски, и модель его не знает. " * 3, "これは日本語の文章です。モデルはこの言語を知りません。" * 4, "Αυτή η πρόταση είναι γραμμένη στα ελληνικά και δεν είναι γνωστή. " * 3, "xq zvkj qqxz jvwq zzkx vqjx kzqw xjvz " * 6]
    got = {r["doc_id"]: r["rejected"] for r in identify_language(docs(spark, list(enumerate([*made, *other]))), m).collect()}
    assert np.mean([got[k] for k in range(len(made))]) > 0.95 and all(got[len(made) + k] for k in range(len(other)))
    real = identify_language(docs(spark, list(enumerate(texts))), m)
    assert real.where("rejected").count() <= 0.02 * len(texts)
    assert keep_identified(docs(spark, list(enumerate([*texts, *made]))), m).count() < len(texts) + 0.1 * len(made)


@pytest.mark.parametrize("rows", [30, 400, 1600])
def test_no_row_trains_and_calibrates(spark, rows):
    df = spark.read.parquet(f"{MID}/documents.parquet").where("lang is not null").select("doc_id", "text", "lang")
    df = df.unionByName(spark.createDataFrame([(-1, "tlhIngan Hol", "one")], df.schema)).unionByName(df.limit(5))
    trained, kept, n = split_rows(df, "doc_id", "lang", rows)
    ids = [{r[0] for r in part.select("doc_id").collect()} for part in (trained, kept)]
    assert ids[0] and ids[1] and not ids[0] & ids[1]
    assert n == df.select("lang").distinct().count() == trained.select("lang").distinct().count()
    assert split_rows(df.limit(0), "doc_id", "lang", rows)[2] == 0


def test_rare_language_is_learned(spark):
    rng = np.random.default_rng(4)
    say = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(40))
    rows = [(k, say("abcdefg"), "aa") for k in range(6000)] + [(9000 + k, say("qrstuvw"), "zz") for k in range(12)]
    m = train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == ["aa", "zz"]
    got = identify_language(docs(spark, [(1, say("qrstuvw")), (2, say("abcdefg"))]), m).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["zz", "aa"]


def test_language_logits_by_plain_loops(spark):
    m = train_language_model(spark.read.parquet(f"{MID}/documents.parquet"))
    for t in ("Hello wörld, 42 x", "a", "été  ...  zz"):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
        raw = b" " + bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in raw) + b" "
        sums, n = np.zeros(m.table.shape[1]), 0
        for k in (2, 3, 4):
            for i in range(len(raw) - k + 1):
                g = raw[i : i + k]
                if 32 in g[1:-1] or (g[0] == 32 and g[-1] == 32):
                    continue
                code = sum(b << (8 * j) for j, b in enumerate(g))
                sums += m.table[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 18]
                n += 1
        data, offsets = buffer_of(pa.array([t]))
        assert np.allclose(text_logits(m, data, offsets)[0], sums / n + m.bias)


def small_network(seed=0):
    rng = np.random.default_rng(seed)
    m = T.ToxicityModel(
        np.concatenate([rng.normal(0, 0.3, (T.ROWS, T.DIM)), np.zeros((1, T.DIM))]).astype(np.float32), [rng.normal(0, 0.3, (w, T.DIM, T.FILTERS)).astype(np.float32) for w in T.WIDTHS],
        rng.normal(0, 0.1, T.FILTERS * len(T.WIDTHS)).astype(np.float32), rng.normal(0, 0.5, T.FILTERS * len(T.WIDTHS)).astype(np.float32), -0.3, {"": 0.5}, None,
    )
    return m


def test_toxicity_forward_by_plain_loops():
    m = small_network()
    texts = ["One two three four", "x", "", "two words", "a b c d e f g h"]
    data, offsets = buffer_of(pa.array(texts))
    rows, place = T.word_rows(data, offsets)
    got = T.raw_scores(m, data, offsets)
    for i in range(len(texts)):
        words = rows[:, place[i] : place[i + 1]]
        x = [sum(m.emb[r] for r in words[:, k]) for k in range(words.shape[1])]
        assert len(x) == len(texts[i].split()) + T.PAD
        answers = []
        for f in range(T.FILTERS * len(T.WIDTHS)):
            w = m.conv[f // T.FILTERS][:, :, f % T.FILTERS]
            at = [m.bias[f] + sum(float(x[k + o] @ w[o]) for o in range(len(w))) for k in range(len(x) - T.PAD)]
            answers.append(max([0.0, *at]))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(np.dot(answers, m.out) + m.base))), abs=1e-5)


def test_toxicity_gradient_is_numerical(monkeypatch):
    m = small_network(1)
    data, offsets = buffer_of(pa.array(["ab cd ef gh ij", "kl mn op", "qr st uv wx yz aa bb"]))
    rows, place = T.word_rows(data, offsets)
    seqs = [rows[:, s : e - T.PAD].astype(np.int32) for s, e in zip(place[:-1], place[1:], strict=True)]
    y = np.array([1, 0, 1])

    def loss(net):
        p, _ = T._forward(net, seqs)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    # one step with all past squares huge and the rate scaled up again is a plain gradient step
    big, rate = 1e12, 1e6 * 1e-3
    grown = {"emb": np.full((len(m.emb), 1), big, np.float32), "out": np.full(len(m.out), big), "bias": np.full(len(m.bias), big), "base": big, "conv": [np.full(w.shape, big, np.float32) for w in m.conv]}
    before = (m.emb.copy(), [w.copy() for w in m.conv], m.bias.copy(), m.out.copy(), m.base)
    start = loss(m)
    T._step(m, seqs, y, grown, rate)
    moved = [m.emb - before[0], *[a - b for a, b in zip(m.conv, before[1], strict=True)], m.bias - before[2], m.out - before[3], np.array([m.base - before[4]])]
    grads = [-d / 1e-3 for d in moved]
    size = sum(float((g.astype(np.float64) ** 2).sum()) for g in grads)
    assert loss(m) < start
    # the loss falls by the squared gradient times the step, to first order
    assert (start - loss(m)) / 1e-3 == pytest.approx(size, rel=0.05)


# urls


def plain_verdicts(pages):
    """Rules by loops, ranks by dense matrices."""
    host = lambda u: re.match(r"[^/?#]*", u.split("://", 1)[1]).group().lower() if u and "://" in u else ""
    path = lambda u: re.sub(r"[?#].*", "", u.split("://", 1)[1][len(host(u)) :]) if u and "://" in u else ""
    got = {}
    for i, u, _ in pages:
        h, p = host(u), path(u)
        fit = [(len(a + b), a + b, v) for v, a, b in RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        got[i] = (h, *(max(fit)[1:] if fit else (None, None)))
    hosts = sorted({h for h, *_ in got.values() if h})
    links = {}
    for _, u, html in pages:
        for to in re.findall(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)""", html or ""):
            a, b = host(u), host("http:" + to if to.startswith("//") else to)
            if a and b and a != b:
                links[a, b] = links.get((a, b), 0) + 1
    kin = {h: h.split(".", 1)[1] for h in hosts if h.count(".") > 1}
    names = sorted({*hosts, *kin.values(), *(x for e in links for x in e)})
    at = {n: k for k, n in enumerate(names)}
    ranks = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        m = np.zeros((len(names), len(names)))
        for (a, b), n in links.items():
            m[(at[b], at[a]) if kind == "trust" else (at[a], at[b])] += n
        if kind == "trust":
            linked = m.sum(0) > 0
            for h, p in kin.items():
                m[at[p], at[h]] += KIN
                m[at[h], at[p]] += KIN / sum(q == p for q in kin.values())
            for h in {*kin, *kin.values()}:
                if not linked[at[h]]:
                    m[at[h], at[h]] += 1 - KIN
        m = 0.85 * np.divide(m, m.sum(0), where=m.sum(0) > 0, out=np.zeros_like(m))
        seed = np.zeros(len(names))
        for h, _, v in got.values():
            if h and v == verdict:
                seed[at[h]] += 1
        total = np.linalg.solve(np.eye(len(names)) - m, seed / max(seed.sum(), 1))
        ranks[kind] = total / max(total.sum(), 1e-300)
    out = {}
    for i, (h, rule, v) in got.items():
        margin = ranks["distrust"][at[h]] - ranks["trust"][at[h]] if h else -1
        out[i] = (h, rule, v or ("block" if margin > 0 else "allow"), abs(margin))
    return out


def test_urls_against_a_plain_version(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{MID}/pages.parquet").select("page_id", "url", "html").collect()]
    pages += [(10**6 + k, f"http://site{k % 9}.biz/x{k}", f'<a href="http://site{(k * 7 + 3) % 9}.biz/">') for k in range(60)] + [(2 * 10**6, "http://a.site1.biz/", '<a href="//example.com/en/1">'), (2 * 10**6 + 1, "http://site4.biz/en/", '<a href=http://m.tionnd.example.org/es/2>')]
    want = plain_verdicts(pages)
    got = judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(want)
    for r in got:
        host, rule, verdict, margin = want[r["page_id"]]
        assert (r["host"], r["rule"]) == (host, rule) and (r["verdict"] == verdict or margin < 1e-6)


@pytest.mark.parametrize("size", [2, 5, 50_000])
def test_blocks_do_not_change_ranks(spark, size):
    rng = np.random.default_rng(1)
    names = [f"h{k}.s{k % 4}.org" for k in range(24)]
    edges = sorted({(str(rng.choice(names)), str(rng.choice(names))) for _ in range(60)})
    df = spark.createDataFrame([("k", a, b, 1 + (i % 3)) for i, (a, b) in enumerate(edges)], "kind string, src string, dst string, n long")
    seeds = spark.createDataFrame([("k", names[0], 1), ("k", names[5], 2)], "kind string, host string, weight long")
    got = {r["host"]: r["rank"] for r in converged_pagerank(df, seeds, block_hosts=size).collect()}
    m = np.zeros((24, 24))
    for i, (a, b) in enumerate(edges):
        m[names.index(b), names.index(a)] = 1 + (i % 3)
    m = 0.85 * np.divide(m, m.sum(0), where=m.sum(0) > 0, out=np.zeros_like(m))
    seed = np.zeros(24)
    seed[[0, 5]] = 1 / 3, 2 / 3
    want = np.linalg.solve(np.eye(24) - m, seed)
    assert sum(abs(got.get(n, 0) - w) for n, w in zip(names, want / want.sum(), strict=True)) < 3e-6


def test_equal_hashes_of_different_words(spark):
    """Two words of 1,024 letters whose hashes are equal: a/b by the parity of one-bits, and the reverse."""
    parity = [bin(k).count("1") % 2 for k in range(1024)]
    one, two = "".join("ab"[b] for b in parity), "".join("ba"[b] for b in parity)
    h, _ = words_of(*buffer_of(pa.array([one, two])))
    assert one != two and h[0] == h[1]
    d = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y"), (3, f"a b {one} c d e f g h i"), (4, f"a b {two} c d e f g h i")], "doc_id long, text string")
    b = spark.createDataFrame([(1, two), (2, f"A b {one} c d e f g h i j")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in D.benchmark_hits(d, b, window=10).collect()}
    assert got == {1: (0, []), 2: (1, ["1"]), 3: (10, ["2"]), 4: (1, ["1"])}
    found = {(r["item"], r["doc_id"]) for r in D.longest_matches(d, b).collect()}
    assert ("2", 3) in found and ("2", 4) not in found
