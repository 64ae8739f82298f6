"""Which aliases a text names: all of them at once, in one pass over each text and without moving it.

The aliases become an automaton of goto and failure links, which walks a text once and reports every
alias that ends at each place; borders are tested there. Aliases are sent to the tasks in blocks of
bounded size, each with an automaton of its own; a worker builds one once and keeps it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestory.shipping import ship

#: Letters of the aliases of a block, about. An automaton takes some dozens of bytes for each.
BLOCK_LETTERS = 1 << 21
ALNUM, DIGITS = set("abcdefghijklmnopqrstuvwxyz0123456789"), set("0123456789")
#: What continues a version after an alias: "model 4" is not named by "model 4.1" or "model 4-mini".
GOES_ON = ALNUM | set(".-")


class AliasBlock:
    """(alias, model) pairs with their automata: of the aliases as they are, for texts with their spaces,
    and of those of five letters or more run together, for texts run together."""

    def __init__(self, pairs: list[tuple[str, object]]):
        self.pairs = pairs
        self._automata = None

    def __getstate__(self):
        return {"pairs": self.pairs, "_automata": None}

    def automata(self):
        if self._automata is None:
            plain, tight = defaultdict(list), defaultdict(list)
            for alias, model in self.pairs:
                run = "".join(c for c in alias if c in ALNUM)
                if run:
                    plain[alias].append(model)
                if len(run) >= 5:
                    tight[run].append(model)
            self._automata = tuple(map(_automaton, (plain, tight)))
        return self._automata

    def models(self, low: str, run: str) -> set:
        plain, tight = self.automata()
        out = set()
        if plain is not None:
            for end, (size, models) in plain.iter(low):
                first = end - size
                if (first < 0 or low[first] not in ALNUM) and (end + 1 == len(low) or low[end + 1] not in GOES_ON):
                    out.update(models)
        if tight is not None:
            for end, (_, models) in tight.iter(run):
                if end + 1 == len(run) or run[end + 1] not in DIGITS:
                    out.update(models)
        return out


def _automaton(words: dict[str, list]):
    if not words:
        return None
    a = ahocorasick.Automaton()
    for w, models in words.items():
        a.add_word(w, (len(w), models))
    a.make_automaton()
    return a


def alias_blocks(aliases: DataFrame) -> Iterator[list[tuple[str, object]]]:
    held, letters = [], 0
    for r in aliases.select("alias", "model_id").where("alias <> ''").toLocalIterator():
        held.append((r["alias"], r["model_id"]))
        letters += len(r["alias"])
        if letters >= BLOCK_LETTERS:
            yield held
            held, letters = [], 0
    if held:
        yield held


def match_aliases(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, model_id: texts that name a model between version borders, or run together (five letters
    or more, no digit after). Texts are lower-cased, with single spaces. A null text names none."""
    spark = ship(texts.sparkSession)
    low = F.lower(text_col)
    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.trim(F.regexp_replace(low, r"\s+", " ")).alias("low"), F.regexp_replace(low, r"[^a-z0-9]", "").alias("run"))
    kind, model = dict(rows.dtypes)["id"], dict(aliases.dtypes)["model_id"]
    model_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[model]
    found = None
    for pairs in alias_blocks(aliases):
        sent = spark.sparkContext.broadcast(AliasBlock(pairs))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for b in batches:
                at, models = [], []
                for i, (text, tight) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    own = block.models(text, tight)
                    at += [i] * len(own)
                    models += own
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(models, model_type)], ["id", "model_id"])

        part = rows.mapInArrow(run, f"id {kind}, model_id {model}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"id {kind}, model_id {model}")
    return found.distinct()
