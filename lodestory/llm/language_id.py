"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its subwords (2 to 4 bytes of a lower-cased word with
its borders), hashed into buckets. Embeddings and softmax are trained together by stochastic
gradient descent in numpy: a few texts of each language give a start on the driver, then every task
goes on over all of its rows, and the tasks' models are averaged. Since both layers are linear, a text's
logits are the mean of one row of logits per bucket, which is all that the scoring tasks carry. A class
beside the languages learns what is none of them, from texts whose letters are shuffled
or replaced by foreign ones. All other texts, kept back from the training at every size of the table,
then set the temperature and, for each language, the confidence below which an answer is rejected.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestory.llm.averaging import SCHEMA, averaged, changes
from lodestory.llm.shared import LOWER, WORD, buffer_of, cut, held_out, own_cache, prepare, slices, trim

BUCKETS = 1 << 14
#: Rows that the start is trained on, about; each language gets an equal part, LEAST_ROWS at least.
START_ROWS, LEAST_ROWS = 1600, 40
#: Share of a language's rows that is trained on; the rest is kept for calibration.
TRAINED_SHARE = 0.8
#: Rate of the first steps; it falls to one part of the number of epochs.
RATE = 20.0
#: Weight of a rare language's texts, at most; a language of the mean size has 1.
MOST_WEIGHT = 10.0
#: Temperatures tried, and bins of confidence for the floors.
TEMPERATURES, BINS = tuple(0.25 * 1.25**k for k in range(20)), 1 << 12
#: Share of a language's rightly named calibration texts that rejection may cost.
REJECTED_SHARE = 0.002
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.where(WORD, LOWER, 0x20).astype(np.uint8)
_DRAWS = 1 << 30


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # BUCKETS x (languages + 1): logits of each bucket, by temperature; last: none of them
    bias: np.ndarray
    floors: np.ndarray  # by language: answers with less confidence are rejected


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the texts, and the text of each."""
    n = len(offsets) - 1
    lens = np.diff(offsets)
    # a border before and after each text
    text = np.full(len(data) + 2 * n, 0x20, np.uint8)
    doc = np.repeat(np.arange(n), lens + 2)
    text[np.arange(len(data)) + 2 * np.repeat(np.arange(n), lens) + 1] = _FOLD[data]
    space = text == 0x20
    code = text.astype(np.uint32)
    out, owner = [], []
    ok = None
    for k in range(1, 4):
        code = code[:-1] | (text[k:].astype(np.uint32) << np.uint32(8 * k))
        # between the first and the last byte there is no border, and not both are borders
        ok = np.ones(len(code), bool) if k == 1 else ok[:-1] & ~space[k - 1 : -1]
        use = ok & ~(space[: len(code)] & space[k:])
        out.append((code[use] * np.uint32(0x9E3779B1)) >> np.uint32(18))
        owner.append(doc[: len(code)][use])
    return np.concatenate(out), np.concatenate(owner)


def text_logits(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logits of each language and of none of them for each text; nan where a text has no subword."""
    n = len(offsets) - 1
    bucket, owner = subwords(data, offsets)
    count = np.bincount(owner, minlength=n)
    sums = np.stack([np.bincount(owner, weights=model.table[:, k][bucket], minlength=n) for k in range(model.table.shape[1])], 1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return sums / count[:, None] + model.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def no_language(text: str) -> str:
    """A text of no language, from a real one: by its checksum all characters shuffled, or each
    letter replaced by one fixed for it from other scripts."""
    seed = zlib.crc32(text.encode())
    rng = np.random.default_rng(seed)
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if seed % 2:
        return rng.permutation(chars).astype("<u4").tobytes().decode("utf-32-le")
    kinds, at = np.unique(chars, return_inverse=True)
    foreign = rng.integers(0x370, 0xD7FF, len(kinds)).astype("<u4")
    return np.where([chr(k).isalpha() for k in kinds], foreign, kinds)[at].astype("<u4").tobytes().decode("utf-32-le")


def split_rows(labelled: DataFrame, id_col: str, lang_col: str, rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows to train on, all other rows to calibrate with, and how many languages there are.

    One draw orders each language's rows: the lowest TRAINED_SHARE is trained on (one row at least), the rest
    calibrates. The two never meet, whatever the table's size; a language of one row has none to calibrate
    with. Repeated rows draw alike and stay together. Rows to train on also say whether they are of the
    start, about `rows` in all (_start), and what they weigh (_weight): less in a language of many rows.
    """
    draw = F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(_DRAWS))
    sizes = labelled.groupBy(lang_col).agg(F.count("*"), F.min(draw)).collect()  # a row a language
    if not sizes:
        return labelled, labelled, 0
    most, mean = max(LEAST_ROWS, rows // len(sizes)), sum(n for _, n, _ in sizes) / len(sizes)
    upto = {lang: max(int(TRAINED_SHARE * _DRAWS), least + 1) for lang, _, least in sizes}
    start = {lang: min(max(int(min(1.0, most / n) * _DRAWS), least + 1), upto[lang]) for lang, n, least in sizes}
    weight = {lang: min(MOST_WEIGHT, mean / n) for lang, n, _ in sizes}
    of = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(lang_col)]
    trained = labelled.where(draw < of(upto)).withColumn("_start", draw < of(start)).withColumn("_weight", of(weight))
    return trained, labelled.where(draw >= of(upto)), len(sizes)


def descend(net: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, step: float, weight: np.ndarray | float = 1.0) -> None:
    """One step of gradient descent: x holds each text's shares of its subwords by bucket, y its class."""
    a = x @ net["emb"]
    d = _softmax(a @ net["soft"] + net["bias"])
    d[np.arange(len(y)), y] -= 1
    d *= (np.broadcast_to(weight, len(y)) / len(y))[:, None]
    da = d @ net["soft"].T
    net["soft"] -= step / 20 * (a.T @ d)
    net["bias"] -= step / 200 * d.sum(0)
    net["emb"] -= step * (x.T @ da)


def trained_on_all(net: dict[str, np.ndarray], texts: DataFrame, langs: list[str], n_langs: int, step: float) -> dict[str, np.ndarray]:
    """The net after every task went over all of its texts (id, text, language, weight), averaged."""
    shared = texts.sparkSession.sparkContext.broadcast(net)  # BUCKETS x dim numbers
    index = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("language")
        own, seen = {k: v.copy() for k, v in shared.value.items()}, 0
        for b in batches:
            ids, langs_, weights = b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            made = [i for i, key in enumerate(ids) if langs_[i] in index and _makes_none(key, n_langs)]
            real = [i for i, lang in enumerate(langs_) if lang in index]
            y = np.array([index[langs_[i]] for i in real] + [len(langs)] * len(made), np.int64)
            w = np.array([weights[i] for i in real] + [1.0] * len(made), np.float32)
            none = pa.array([no_language(b.column(1)[i].as_py()) for i in made], b.column(1).type)
            order = np.random.default_rng(len(y)).permutation(len(y))
            data, offsets = buffer_of(pa.concat_arrays([b.column(1).take(pa.array(real, pa.int64())), none]).take(pa.array(order)))
            for lo in range(0, len(y), 32):
                hi = min(lo + 32, len(y))
                bucket, owner = subwords(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                x = np.bincount(owner * BUCKETS + bucket, minlength=(hi - lo) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)
                n = x.sum(1)
                at = order[lo:hi][n > 0]
                if len(at):
                    descend(own, x[n > 0] / n[n > 0, None], y[at], step, w[at])
                    seen += len(at)
        if seen:
            yield from changes(TaskContext.get().partitionId(), seen, shared.value, own)

    return averaged(texts.mapInArrow(run, SCHEMA), net)


def _makes_none(key, n_langs: int) -> bool:
    """Whether a text of no language is made from the row: twice as many as a language has rows."""
    return zlib.crc32(str(key).encode()) % n_langs < 2


def train_language_model(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = START_ROWS, dim: int = 16, epochs: int = 6, seed: int = 5) -> LanguageModel | None:
    """Learn from all labelled texts that are not held out; None if there are none.

    About `rows` of them, of each language alike, give a start: the tasks turn these into bucket counts, and
    the driver gets the counts alone. Where there are more, one pass over all rows to train on follows.
    """
    prepare(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, text_col, lang_col)
    trained, kept, n_langs = split_rows(labelled, id_col, lang_col, rows)
    if not n_langs:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("language")
        for b in batches:
            ids, langs, keys, vals = [], [], [], []
            for i, t, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made = [(no_language(t), None)] if _makes_none(i, n_langs) else []
                for text, name in [(t, lang), *made]:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    k, v = np.unique(subwords(raw, np.array([0, len(raw)]))[0], return_counts=True)
                    if len(k):
                        ids.append(i)
                        langs.append(name)
                        keys.append(k.astype(np.int32))
                        vals.append((v / v.sum()).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(langs, pa.string()), pa.array(keys, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))], ["id", "lang", "keys", "vals"])

    got = trained.where("_start").select(id_col, text_col, lang_col).mapInArrow(count, f"id {dict(docs.dtypes)[id_col]}, lang string, keys array<int>, vals array<float>").toArrow()
    got = got.combine_chunks()
    langs = sorted(set(got["lang"].to_pylist()) - {None})
    if not langs:
        return None
    y = np.array([langs.index(x) if x is not None else len(langs) for x in got["lang"].to_pylist()])
    # the order of rows is the tasks'; training goes by id, texts of no language behind their own
    by_id = np.lexsort((y, pc.rank(got["id"], sort_keys="ascending", tiebreaker="dense").to_numpy()))
    edge = np.concatenate(([0], np.cumsum(pc.list_value_length(got["keys"]).to_numpy())))
    flat_keys, flat_vals = pc.list_flatten(got["keys"]).to_numpy(), pc.list_flatten(got["vals"]).to_numpy()
    del got
    rng = np.random.default_rng(seed)
    # languages weigh alike: a rare one's texts come again; no language comes twice as often as one
    most = max(np.bincount(y)[: len(langs)])
    of = lambda k: by_id[y[by_id] == k]
    train = rng.permutation(np.concatenate([np.resize(of(k), most) for k in range(len(langs))] + [of(len(langs))[: 2 * most]]))

    def dense(idx: np.ndarray) -> np.ndarray:
        x = np.zeros((len(idx), BUCKETS), np.float32)
        for r, i in enumerate(idx):
            x[r, flat_keys[edge[i] : edge[i + 1]]] = flat_vals[edge[i] : edge[i + 1]]
        return x

    net = {"emb": rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32), "soft": rng.normal(0, 0.1, (dim, len(langs) + 1)).astype(np.float32), "bias": np.zeros(len(langs) + 1, np.float32)}
    for epoch in range(epochs):
        for lo in range(0, len(train), 32):
            idx = train[lo : lo + 32]
            descend(net, dense(idx), y[idx], RATE * (1 - epoch / epochs))
        rng.shuffle(train)
    del flat_keys, flat_vals
    trim()
    if trained.where("not _start").limit(1).count():
        net = trained_on_all(net, trained.select(id_col, text_col, lang_col, "_weight"), langs, n_langs, RATE / epochs)
    model = LanguageModel(langs, (net["emb"] @ net["soft"]).astype(np.float64), net["bias"].astype(np.float64), np.zeros(len(langs)))
    return calibrated(model, kept, text_col, lang_col)


def calibrated(model: LanguageModel, texts: DataFrame, text_col: str, lang_col: str) -> LanguageModel:
    """The model with its temperature (least loss, languages weighing alike) and floors (REJECTED_SHARE of a
    language's rightly named texts lie below; half the least confidence where they are too few to tell).

    All texts count; of each task the driver gets sums, and of each language the counts by bin of confidence.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    n, index = len(model.langs), {lang: k for k, lang in enumerate(model.langs)}

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("language")
        for b in batches:
            data, offsets = buffer_of(b.column(0))
            y = np.array([index.get(lang, -1) for lang in b.column(1).to_pylist()], np.int32)
            for lo, hi in slices(offsets, 1 << 18):
                z = text_logits(shared.value, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ok = ~np.isnan(z[:, 0]) & (y[lo:hi] >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(y[lo:hi][ok]), pa.array(list(z[ok]), pa.list_(pa.float64()))], ["y", "z"])

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return b.column(0).to_numpy(), pc.list_flatten(b.column(1)).to_numpy().reshape(-1, n + 1)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(TEMPERATURES), n)), np.zeros(n, np.int64)
        for b in batches:
            y, z = read(b)
            count += np.bincount(y, minlength=n)
            for k, t in enumerate(TEMPERATURES):
                total[k] += np.bincount(y, weights=-np.log(_softmax(z[:, :n] * t)[np.arange(len(y)), y] + 1e-12), minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array([count.tolist()], pa.list_(pa.int64())), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["n", "loss"])

    found = cut(texts.select(text_col, lang_col).mapInArrow(logits, "y int, z array<double>"))  # a few numbers a text
    sums = found.mapInArrow(losses, "n array<long>, loss array<double>").toPandas()
    count = np.sum([np.asarray(c) for c in sums["n"]], 0) if len(sums) else np.zeros(n)
    if not count.sum():
        return model
    loss = np.array([math.fsum(task) for task in zip(*sums["loss"], strict=True)]).reshape(-1, n)  # rounds once, in whatever order
    best = TEMPERATURES[int((loss / np.maximum(count, 1)).sum(1).argmin())]

    def confidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, z = read(b)
            right = z[:, :n].argmax(1) == y
            sure = _softmax(z * best)[np.arange(len(y)), y][right]
            yield pa.RecordBatch.from_arrays([pa.array(y[right]), pa.array(sure)], ["y", "p"])

    bins = found.mapInArrow(confidences, "y int, p double").groupBy("y", F.floor(F.col("p") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.min("p").alias("p")).toPandas().sort_values("bin")
    floors = np.zeros(n)
    for k, of in bins.groupby("y"):
        upto, p = of["n"].cumsum().to_numpy(), of["p"].to_numpy()
        at = int(REJECTED_SHARE * upto[-1])
        floors[k] = p[np.searchsorted(upto, at, "right")] if at else p[0] / 2
    return LanguageModel(model.langs, model.table * best, model.bias * best, floors)


def identify_language(docs: DataFrame, model: LanguageModel | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict each text's language from the text alone.

    Returns id, lang_pred, score (calibrated probability among the languages, 0 to 1) and rejected
    (no letter, or less sure than the language's floor that it is this and no other or none). `und` with score 0 where a text is null, empty, without
    a letter, or nothing was learned. Row by row: ties go to the first language by name,
    repeated rows get the same answer, other columns have no effect; map-only.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("language")
        m = shared.value
        for b in batches:
            preds, scores, reject = judge_batch(m, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(reject, pa.bool_())], [id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel | None, *, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is not rejected.

    Without a model (nothing to learn from) only texts without a letter go.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_cache("language")
        m = shared.value
        for b in batches:
            _, _, reject = judge_batch(m, b.column(at))
            yield b.filter(pa.array([not r for r in reject], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge_batch(m: LanguageModel | None, texts: pa.Array) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and whether the answer is rejected; without a model only texts without a letter are."""
    data, offsets = buffer_of(texts)
    preds, scores, reject = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
    for lo, hi in slices(offsets, 1 << 18) if m else ():
        z = np.nan_to_num(text_logits(m, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
        among, all_ = _softmax(z[:, :-1]), _softmax(z)
        k, row = among.argmax(1), np.arange(hi - lo)
        preds[lo:hi] = [m.langs[i] for i in k]
        scores[lo:hi] = among[row, k].tolist()
        reject[lo:hi] = (all_[row, k] < m.floors[k]).tolist()
    for i, t in enumerate(texts.to_pylist()):
        if t is None or not _LETTER.search(t):
            preds[i], scores[i], reject[i] = UNKNOWN, 0.0, True
    return preds, scores, reject


def predict_batch(m: LanguageModel | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    return judge_batch(m, texts)[:2]
