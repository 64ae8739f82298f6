"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its beginnings. Filters of
several widths slide over the whole text, each keeps its largest answer, and a logistic
unit weighs them. A few thousand labelled texts give a start on the driver, then every task goes
on over all of its labelled texts, and the tasks' networks are averaged. All texts of a part kept
back set one threshold per language (named from the text), and scores are bent so that each
language's threshold lies at the same score.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestory.llm.averaging import SCHEMA, averaged, changes
from lodestory.llm.language_id import LanguageModel, predict_batch
from lodestory.llm.shared import LOWER, WORD, buffer_of, cut, held_out, prefix_hash, prepare, range_hash, slices

BUCKETS = 1 << 15
DIM, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
PAD = max(WIDTHS) - 1
#: Labelled texts of the start: toxic and clean, about; their part of all labelled texts sets what a class weighs.
START_TOXIC, START_CLEAN = 3000, 5000
#: Bytes of their texts, about; of longer texts fewer are taken.
START_BYTES = 48 << 20
#: Starts, of which the one with the least loss goes on: some miss the words of a language.
STARTS = 2
#: Of all labelled texts one in so many is kept back for the thresholds.
KEPT_BACK = 5
#: Learning rate (Adagrad), and bins of scores for the thresholds.
RATE, BINS = 0.08, 1 << 14
THRESHOLD = 0.3
#: Toxic texts kept back, at least, for a threshold of a language's own (or any at all).
LEAST_TOXIC = 10
#: Bytes of a word's beginnings, which have embeddings of their own.
STEMS = (4, 5)
ROWS = (1 + len(STEMS)) * BUCKETS


@dataclass
class ToxicityModel:
    emb: np.ndarray  # ROWS + 1 rows; the last is zero, for the space between texts
    conv: list[np.ndarray]  # width x DIM x FILTERS each
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: dict[str, float]
    languages: LanguageModel | None


def word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word and its beginnings (one line each), with PAD empty words after
    each text, and each text's first place (n + 1)."""
    n = len(offsets) - 1
    inside = WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = prefix_hash(LOWER[data])
    text_of = np.searchsorted(start, offsets)
    place = text_of + PAD * np.arange(n + 1)
    rows = np.full((1 + len(STEMS), len(start) + PAD * n), ROWS, np.int64)
    at = np.arange(len(start)) + PAD * np.repeat(np.arange(n), np.diff(text_of))
    for k, most in enumerate((1 << 40, *STEMS)):
        rows[k, at] = (range_hash(h, start, np.minimum(end, start + most)) >> np.uint64(49)).astype(np.int64) + k * BUCKETS
    return rows, place


def _answers(m: ToxicityModel, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors, and every filter's answer at every word."""
    x = m.emb[rows[0]]
    for r in rows[1:]:
        x += m.emb[r]
    n = len(x)
    z = np.zeros((n, FILTERS * len(WIDTHS)), np.float32) + m.bias
    for k, w in enumerate(m.conv):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        for o in range(len(w)):
            z[: n - o, cols] += x[o:] @ w[o]
    z[rows[0] == ROWS] = -np.inf  # no answer begins in the space after a text, where the next one is near
    return x, z


def raw_scores(m: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows, place = word_rows(data, offsets)
    if len(place) == 1:
        return np.zeros(0)
    _, z = _answers(m, rows)
    top = np.maximum(np.maximum.reduceat(z, place[:-1], axis=0), 0)
    return 1 / (1 + np.exp(-(top @ m.out + m.base).astype(np.float64)))


def train_toxicity_model(docs: DataFrame, labels: DataFrame, languages: LanguageModel | None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", epochs: int = 8, seed: int = 3) -> ToxicityModel | None:
    """Learn from all labelled texts that are not held out.

    Null labels, labels other than 0 and 1, null texts and null ids teach nothing. None if one of the
    classes is missing. With under 100 texts the training texts set the thresholds too. START_TOXIC +
    START_CLEAN texts, START_BYTES in all, at most about, train on the driver; where there are more, one
    pass over all of them follows, in which the classes weigh as they do in the start.
    """
    prepare(docs.sparkSession)
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    draw = lambda salt: F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(1 << 30))
    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, text_col).join(rows.hint("merge"), id_col)  # one plan whatever the size
    texts = cut(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("_y").alias("y"), draw(29).alias("draw"), (draw(31) % KEPT_BACK == 0).alias("kept")))
    found = {r["y"]: r for r in texts.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"), F.sum(F.col("kept").cast("int")).alias("kept")).collect()}
    if len(found) < 2:
        return None
    whole = sum(r["n"] for r in found.values()) < 100 or any(r["kept"] == r["n"] for r in found.values())
    train, kept = (texts, texts) if whole else (texts.where("not kept"), texts.where("kept"))
    share = {k: min(1.0, most / found[k]["n"]) for k, most in ((1, START_TOXIC), (0, START_CLEAN))}
    size = sum(share[k] * (r["size"] or 0) for k, r in found.items())
    share = {k: v * min(1.0, START_BYTES / max(1, size)) for k, v in share.items()}
    bound = F.when(F.col("y") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(buffer_of(batch.column(1))[1], 1 << 19):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([q.tobytes() for q in _sequences(part.column(1))], pa.binary())], ["id", "y", "seq"])

    got = train.where(F.col("draw") < bound).select("id", "text", "y").mapInArrow(encode, f"id {dict(docs.dtypes)[id_col]}, y int, seq binary").toArrow().sort_by("id")
    seqs = [np.frombuffer(q, "<i4").reshape(1 + len(STEMS), -1) for q in got["seq"].to_pylist()]
    y = np.array(got["y"].to_pylist())
    starts = [_start(seqs, y, languages, epochs, seed + k) for k in range(STARTS)]
    _, m, grown = min(starts, key=lambda of: of[0])
    del seqs, got
    if min(share.values()) < 1:
        mean = sum(share[k] * r["n"] for k, r in found.items()) / sum(r["n"] for r in found.values())
        m = _trained_on_all(m, grown, train.select("text", "y"), np.array([share[0] / mean, share[1] / mean]))
    m.thresholds = _thresholds(m, kept.select("text", "y"))
    return m


def _start(seqs: list[np.ndarray], y: np.ndarray, languages: LanguageModel | None, epochs: int, seed: int) -> tuple[float, ToxicityModel, dict]:
    """Loss, network and squared gradients after so many epochs over texts in memory."""
    rng = np.random.default_rng(seed)
    m = ToxicityModel(
        np.concatenate([rng.normal(0, 0.05, (ROWS, DIM)), np.zeros((1, DIM))]).astype(np.float32),
        [rng.normal(0, (DIM * w) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), -1.0, {}, languages,
    )
    order = rng.permutation(len(y))
    grown = {"emb": np.full((len(m.emb), 1), 1e-6, np.float32), "out": np.full(len(m.out), 1e-6), "bias": np.full(len(m.bias), 1e-6), "base": 1e-6, "conv": [np.full(w.shape, 1e-6, np.float32) for w in m.conv]}
    for _ in range(epochs):
        for lo in range(0, len(order), 32):
            _step(m, [seqs[i] for i in order[lo : lo + 32]], y[order[lo : lo + 32]], grown, RATE)
        rng.shuffle(order)
    m.emb[-1] = 0
    p = np.concatenate([_forward(m, seqs[lo : lo + 64])[0] for lo in range(0, len(y), 64)])
    return float(-np.log(np.where(y == 1, p, 1 - p) + 1e-9).mean()), m, grown


def _sequences(texts: pa.Array) -> list[np.ndarray]:
    rows, place = word_rows(*buffer_of(texts))
    return [rows[:, s : e - PAD].astype("<i4") for s, e in zip(place[:-1], place[1:], strict=True)]


def _parameters(m: ToxicityModel) -> dict[str, np.ndarray]:
    return {"emb": m.emb, **{f"conv{k}": w for k, w in enumerate(m.conv)}, "bias": m.bias, "out": m.out, "base": np.array([m.base])}


def _trained_on_all(m: ToxicityModel, grown: dict, texts: DataFrame, weights: np.ndarray) -> ToxicityModel:
    """The network after every task went over all of its texts (text, y), averaged; weights: of each class."""
    shared = texts.sparkSession.sparkContext.broadcast((replace(m, languages=None), grown))  # a few MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, past), seen = copy.deepcopy(shared.value), 0
        for batch in batches:
            batch = batch.take(pa.array(np.random.default_rng(batch.num_rows).permutation(batch.num_rows)))
            for lo, hi in slices(buffer_of(batch.column(0))[1], 1 << 19):
                seqs, y = _sequences(batch.column(0).slice(lo, hi - lo)), batch.column(1).slice(lo, hi - lo).to_numpy()
                for at in range(0, len(y), 32):
                    _step(own, seqs[at : at + 32], y[at : at + 32], past, RATE / 4, weights[y[at : at + 32]])
                seen += len(y)
        if seen:
            yield from changes(TaskContext.get().partitionId(), seen, _parameters(shared.value[0]), _parameters(own))

    new = averaged(texts.mapInArrow(run, SCHEMA), _parameters(m))
    return replace(m, emb=new["emb"], conv=[new[f"conv{k}"] for k in range(len(WIDTHS))], bias=new["bias"], out=new["out"], base=float(new["base"][0]))


def _layout(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gap = np.full((1 + len(STEMS), PAD), ROWS, np.int32)
    flat = np.concatenate([p for s in seqs for p in (s, gap)], 1)
    place = np.concatenate(([0], np.cumsum([s.shape[1] + PAD for s in seqs])))
    return flat, place


def _forward(m: ToxicityModel, seqs: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
    words, place = _layout(seqs)
    x, z = _answers(m, words)
    arg = np.stack([z[s:e].argmax(0) + s for s, e in zip(place[:-1], place[1:], strict=True)])
    top = np.maximum(z[arg, np.arange(z.shape[1])], 0)
    return 1 / (1 + np.exp(-(top @ m.out + m.base))), (words, x, arg, top)


def _step(m: ToxicityModel, seqs: list[np.ndarray], y: np.ndarray, grown: dict, rate: float, weight: np.ndarray | float = 1.0) -> None:
    p, (words, x, arg, top) = _forward(m, seqs)
    d = (weight * (p - y) / len(y)).astype(np.float32)
    dtop = d[:, None] * m.out * (top > 0)
    emb_rows, emb_grads = [], []

    def move(name: str, value: np.ndarray, grad: np.ndarray, past: np.ndarray) -> None:
        past += grad**2
        value -= rate * grad / np.sqrt(past)

    gout, gbias, gbase = top.T @ d, dtop.sum(0), float(d.sum())
    for k, w in enumerate(m.conv):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        g = dtop[:, cols]
        gw = np.empty_like(w)
        for o in range(len(w)):
            rows = np.minimum(arg[:, cols] + o, len(x) - 1)
            gw[o] = np.einsum("bfd,bf->df", x[rows], g)
            dx = (g[:, :, None] * w[o].T[None]).reshape(-1, DIM)
            for side in words:
                emb_rows.append(side[rows].ravel())
                emb_grads.append(dx)
        move("conv", w, gw, grown["conv"][k])
    move("out", m.out, gout, grown["out"])
    move("bias", m.bias, gbias, grown["bias"])
    grown["base"] += gbase**2
    m.base -= rate * gbase / grown["base"] ** 0.5
    rows, inverse = np.unique(np.concatenate(emb_rows), return_inverse=True)
    total = np.zeros((len(rows), DIM), np.float32)
    np.add.at(total, inverse, np.concatenate(emb_grads))
    real = rows < ROWS
    rows, total = rows[real], total[real]
    grown["emb"][rows] += (total**2).mean(1, keepdims=True)
    m.emb[rows] -= rate * total / np.sqrt(grown["emb"][rows])


def _thresholds(m: ToxicityModel, texts: DataFrame) -> dict[str, float]:
    """Thresholds by language, and one for all (""); of each the driver gets counts by bin of score."""
    shared = texts.sparkSession.sparkContext.broadcast(m)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _ = predict_batch(shared.value.languages, batch.column(0))
            data, offsets = buffer_of(batch.column(0))
            s = [raw_scores(shared.value, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets, 1 << 19)]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), batch.column(1), pa.array(np.concatenate([*s, np.zeros(0)]))], ["lang", "y", "s"])

    scored = texts.mapInArrow(scores, "lang string, y int, s double")
    bins = scored.groupBy("lang", F.floor(F.col("s") * BINS).alias("bin")).agg(F.sum("y").alias("toxic"), F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).toPandas()
    out = {}
    for name in [*sorted(set(bins["lang"])), ""]:
        use = bins if name == "" else bins[bins["lang"] == name]
        if use["toxic"].sum() >= LEAST_TOXIC and use["toxic"].sum() < use["n"].sum():
            out[name] = _threshold(use)
    return out if "" in out else {**out, "": 0.5}


def _threshold(bins: pd.DataFrame) -> float:
    """The score that separates best by F1, at the middle of its gap."""
    bins = bins.groupby("bin").agg({"toxic": "sum", "n": "sum", "low": "min", "high": "max"}).sort_index(ascending=False)
    tp, all_ = bins["toxic"].cumsum().to_numpy(float), bins["n"].cumsum().to_numpy(float)
    k = int((2 * tp / (all_ + tp[-1])).argmax())
    below = bins["high"].iloc[k + 1] if k + 1 < len(bins) else 0.0
    return float(np.clip((bins["low"].iloc[k] + below) / 2, 0.1, 0.9))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts: id, score (0 to 1), predicted (1 at THRESHOLD or more), lang_pred.

    A null or empty text has no words and gets the score of silence. Without a model all scores
    are 0. Row by row and map-only: repeated rows score the same, other columns have no effect.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            langs, _ = predict_batch(m.languages if m else None, batch.column(1))
            s = np.zeros(batch.num_rows)
            for lo, hi in slices(offsets, 1 << 19) if m else ():
                s[lo:hi] = raw_scores(m, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if m:
                t = np.array([m.thresholds.get(x, m.thresholds[""]) for x in langs])
                s = np.where(s < t, s / t * THRESHOLD, THRESHOLD + (s - t) / (1 - t) * (1 - THRESHOLD))
            s = np.clip(s, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(langs, pa.string())], [id_col, "score", "predicted", "lang_pred"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, predicted int, lang_pred string")
