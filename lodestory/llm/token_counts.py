"""Token counts of every prefix, by dynamic programming over the prefixes of words.

The tokens of a prefix are those of its whole pre-tokens plus those of the word that it cuts.
For one word, let inner(i) be the last token of the merge result of its first i bytes
without a word end. A token t that ends at i is that last token exactly when the merges
leave the pair (inner(i - len(t)), t) as it is, so each prefix follows from shorter ones;
a cut word ends in a token with the word-end mark, found the same way. No prefix is encoded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate, islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lodestory.llm.encoding import _ODD, _SPECIAL
from lodestory.llm.shared import own_cache, prepare, ragged

#: Word pieces of the vocabulary; white space separates and is dropped.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Pieces that the split makes only when they are complete.
_WHOLE_ONLY = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
#: Prefixes and chunks kept by a worker before it starts anew.
MOST_PREFIXES, MOST_CHUNKS, FIRST_CHUNKS = 1_200_000, 500_000, 150_000
#: Signs of a pre-token above which its prefixes are known by their places, not kept as strings.
LONG = 64
END = "</w>"


def byte_signs() -> list[str]:
    """The sign that byte-level vocabularies use for each byte: itself if printable, else 256 + k."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Exact token counts of all prefixes under a word-end BPE vocabulary."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("end_of_word_suffix") != END:
            raise ValueError("a vocabulary with word-end marks is needed")
        self.vocab = model["vocab"]
        self.longest = max(map(len, self.vocab))
        self.signs = byte_signs()
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}
        for i, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.rank[left, right] = i
            self.made.setdefault(left + right, (i, left, right))
        self.clear()

    def clear(self) -> None:
        self.clear_prefixes()
        self.clear_chunks()

    def clear_prefixes(self) -> None:
        self.inner: dict[str, tuple[str, int]] = {}
        self.ends: dict[str, int] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def clear_chunks(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def stays(self, a: str, b: str) -> bool:
        """Whether the merges leave token a followed by token b as these two tokens.

        Undo the merges that made the two, latest first; if the two signs at the border could
        have merged before the merge just undone, they would have, and the pair breaks.
        """
        key, limit = (a, b), 1 << 40
        got = self.pairs.get(key)
        while got is None:
            if self.rank.get((a, b), 1 << 40) < limit:
                got = False
                break
            x, y = self.made.get(a), self.made.get(b)
            if x is None and y is None:
                got = True
            elif y is None or (x is not None and x[0] > y[0]):
                limit, a = x[0], x[2]
            else:  # of two equal merges the left one is made first
                limit, b = y[0] + 1, y[1]
        self.pairs[key] = got
        return got

    def whole(self, t: str) -> bool:
        """Whether the merges make a token from its own signs."""
        got = self.made.get(t)
        return got is None or (self.whole(got[1]) and self.whole(got[2]) and self.stays_until(got))

    def stays_until(self, made: tuple[int, str, str]) -> bool:
        """Whether nothing merges across the border of a token's halves before the two merge."""
        i, a, b = made
        limit = 1 << 40
        while True:
            r = self.rank.get((a, b), 1 << 40)
            if r < limit and r < i:
                return False
            x, y = self.made.get(a), self.made.get(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and x[0] > y[0]):
                limit, a = x[0], x[2]
            else:
                limit, b = y[0] + 1, y[1]

    def last(self, s: str, i: int, end: str, guess: int) -> tuple[str, int]:
        """Last token of s[:i] and the number of its tokens; shorter prefixes must be known.

        Only one token fits; `guess` is where it is likely to start, and is tried first.
        """
        vocab, inner, pairs = self.vocab, self.inner, self.pairs
        if guess > 0 and (t := s[guess:i] + end) in vocab:
            before, n = inner[s[:guess]]
            got = pairs.get((before, t))
            if got or (got is None and self.stays(before, t)):
                return t, n + 1
        for k in range(max(0, i - self.longest), i):
            t = s[k:i] + end
            if t in vocab:
                if k == 0:
                    if self.whole(t):
                        return t, 1
                    continue
                before, n = inner[s[:k]]
                got = pairs.get((before, t))
                if got or (got is None and self.stays(before, t)):
                    return t, n + 1
        raise ValueError("the vocabulary lacks a byte")

    def grow(self, s: str) -> None:
        """Make all prefixes of a pre-token in byte signs known, shorter ones first."""
        inner, ends = self.inner, self.ends
        known = len(s)
        while known > 0 and s[:known] not in inner:
            known -= 1
        at = known - len(inner[s[:known]][0]) if known else 0
        for i in range(known + 1, len(s) + 1):
            p = s[:i]
            got = inner[p] = self.last(s, i, "", at)
            at = i - len(got[0])
            ends[p] = self.last(s, i, END, at)[1]

    def long_ends(self, s: str) -> list[int]:
        """Counts of a long pre-token's prefixes by their number of signs, from the last token and
        the count at each place: memory grows with its length, whatever its prefixes hold."""
        token, count, ends = [""], [0], [0]

        def last(i: int, end: str, guess: int) -> tuple[int, str]:
            for k in (guess, *range(max(0, i - self.longest), i)):
                t = s[k:i] + end
                if t in self.vocab and (self.stays(token[k], t) if k else self.whole(t)):
                    return k, t
            raise ValueError("the vocabulary lacks a byte")

        at = 0
        for i in range(1, len(s) + 1):
            at, t = last(i, "", at)
            token.append(t)
            count.append(count[at] + 1)
            ends.append(count[last(i, END, at)[0]] + 1)
            if len(self.pairs) > MOST_PREFIXES:
                self.pairs.clear()
        return ends

    def count_signs(self, s: str) -> int:
        """Tokens of a whole pre-token in byte signs."""
        if len(s) > LONG:
            return self.long_ends(s)[-1]
        if s not in self.ends:
            self.grow(s)
        return self.ends[s]

    def piece(self, w: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of one pre-token."""
        if w in _WHOLE_ONLY:
            return [1, *(1 + self.piece(w[1:i])[-1] for i in range(2, len(w))), self.count_signs(w)]
        if w.isascii() and w.isprintable():
            s, cuts = w, range(1, len(w) + 1)
        else:
            parts = ["".join([self.signs[b] for b in ch.encode()]) for ch in w]
            s, cuts = "".join(parts), list(accumulate(map(len, parts)))
        if len(s) > LONG:
            ends = self.long_ends(s)
            return [ends[i] for i in cuts]
        if s not in self.ends:
            self.grow(s)
        ends = self.ends
        return [ends[s[:i]] for i in cuts]

    def learn(self, chunks: list[str]) -> None:
        """Keep the tables of chunks without white space, each with its last count once more."""
        new: list[int] = []
        sizes = []
        for c in chunks:
            n, base = len(new), 0
            if len(self.inner) > MOST_PREFIXES:
                self.clear_prefixes()
            for w in _PIECE.findall(c):
                t = self.piece(w)
                new += [x + base for x in t] if base else t
                base += t[-1]
            new.append(base)
            sizes.append(len(new) - n)
        k, n = len(self.index), len(chunks)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(new), len(self.flat)), np.int32)])
        if k + n > len(self.start):
            more = max(len(self.start), n)
            self.start, self.size = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(new)] = new
        size = np.array(sizes, np.int64)
        self.start[k : k + n] = self.used + np.cumsum(size) - size
        self.size[k : k + n] = size
        self.index.update(zip(chunks, range(k, k + n), strict=True))
        self.used += len(new)

    def table(self, text: str) -> np.ndarray:
        """Token count of every prefix of a text, 0 characters first; the last is the text's own.

        Prefixes are of the normalised text (NFC, lower case, white-space runs as one space),
        which is what the vocabulary sees; for plain texts only case and white space differ.
        A special string counts one when it is complete, by its characters before.
        """
        if len(self.index) > MOST_CHUNKS:
            self.index = dict(islice(self.index.items(), FIRST_CHUNKS))
            self.used = int(self.start[FIRST_CHUNKS])
        if _ODD.search(text) or ("<|" in text and _SPECIAL.search(text)):
            return self.odd_table(text)
        chunks = text.lower().split()
        if not chunks:
            return np.zeros(1 + bool(text), np.int32)
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        if (miss := np.flatnonzero(at < 0)).size:
            self.learn(list({chunks[i] for i in miss}))
            at[miss] = [self.index[chunks[i]] for i in miss]
        lens = self.size[at]
        flat = self.flat[ragged(self.start[at], lens)]
        last = flat[np.cumsum(lens) - 1]
        flat += np.repeat(np.cumsum(last) - last, lens).astype(np.int32)
        front = 1 + text[0].isspace()
        out = np.zeros(front + len(flat), np.int32)
        out[front:] = flat
        return out if text[-1].isspace() else out[:-1]

    def odd_table(self, text: str) -> np.ndarray:
        """The same with the library's own normaliser and split, and its special strings."""
        specials = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        out, base = [np.zeros(1, np.int32)], 0
        for k, part in enumerate(cut.split(text) if cut else [text]):
            if k % 2:
                before = self.odd_part(part[:-1])
                t = np.append(before, 1).astype(np.int32)
            else:
                t = self.odd_part(part)
            out.append(t[1:] + base)
            base += int(t[-1])
        return np.concatenate(out)

    def odd_part(self, text: str) -> np.ndarray:
        norm = self.tok.normalizer.normalize_str(text)
        at, tables = [], []
        for signs, (lo, hi) in self.tok.pre_tokenizer.pre_tokenize_str(norm):
            w = norm[lo:hi]
            if "".join(self.signs[b] for b in w.encode()) == signs:
                tables.append(np.array(self.piece(w), np.int32))
            else:
                n = self.count_signs(signs)
                tables.append(np.full(max(1, hi - lo), n, np.int32))
            at.append(lo)
        return _laid(len(norm), at, tables)


def _laid(n: int, at: list[int], tables: list[np.ndarray]) -> np.ndarray:
    """Put the pieces' tables at their places: a prefix has the whole pieces before it and its own."""
    if not tables:
        return np.zeros(n + 1, np.int32)
    lens = np.fromiter(map(len, tables), np.int64, len(tables))
    flat = np.concatenate(tables)
    last = flat[np.cumsum(lens) - 1]
    base = np.cumsum(last) - last
    step = np.zeros(n + 1, np.int32)
    place = np.repeat(np.array(at) + 1 - (np.cumsum(lens) - lens), lens) + np.arange(len(flat))
    flat = flat + np.repeat(base, lens)
    step[place] = flat
    return np.maximum.accumulate(step) if not len(_drops(step, place)) else _held(step, place)


def _drops(step: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(step[place]) < 0)


def _held(step: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Between pieces the count of the last prefix holds; counts may fall inside a word."""
    src = np.zeros(len(step), np.int64)
    src[place] = place
    return step[np.maximum.accumulate(src)]


def counter(path: str) -> PrefixCounter:
    kept = own_cache("prefixes")
    if path not in kept:
        kept[path] = PrefixCounter(path)
    return kept[path]


def tokens_before(table: np.ndarray, chars: int) -> int:
    """Tokens of the text cut to so many (normalised) characters."""
    return int(table[min(max(chars, 0), len(table) - 1)])


def longest_within(table: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most `budget` tokens."""
    return int(np.flatnonzero(table <= budget)[-1]) if len(table) else 0


def prefix_token_counts(
    docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", budget: int = 2048, keep_table: bool = False
) -> DataFrame:
    """Token counts of whole texts and, if asked, of all their prefixes.

    Returns id, n_bytes, n_tokens, over_limit (more tokens than the budget), fits_chars (the
    longest prefix within the budget, in normalised characters) and, with keep_table,
    prefix_tokens (array<int>, one entry for each prefix from 0 characters). A null text is
    empty: 0 bytes, 0 tokens. Rows are handled one by one: nulls in other columns, repeated
    rows and other columns have no effect; an empty frame gives none. Map-only, no shuffle.
    """
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"
    schema += ", prefix_tokens array<int>" if keep_table else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            n_bytes, n_tokens, fits, tables = [], [], [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                table = c.table(t)
                n_bytes.append(len(t.encode()))
                n_tokens.append(int(table[-1]))
                fits.append(len(table) - 1 if table[-1] <= budget else longest_within(table, budget))
                if keep_table:
                    tables.append(table)
            cols = [b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > budget for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "over_limit", "fits_chars"]
            if keep_table:
                cols.append(pa.array(tables, pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
