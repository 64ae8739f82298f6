"""Exact batch encoding with the tokenizers library, one library call per distinct chunk.

A pre-token never contains white space after another character, so a text may be split
before each run of white space and each chunk encoded alone. Chunks repeat: a batch is cut
by its bytes and dictionary-encoded, so each distinct chunk is looked up once, and each
worker keeps the ids of those it has met. Texts with characters outside a plain set (where the
library's Unicode rules could differ from the split) go to the library whole.
"""

from __future__ import annotations

import json
import re
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lodestory.llm.shared import LOWER, buffer_of, own_cache, ragged, slices

#: Chunks that a worker keeps at most; then all but the first, the commonest, are forgotten.
MOST_CHUNKS, FIRST_CHUNKS = 450_000, 200_000
#: Outside this set a text is encoded whole.
_ODD = re.compile("[^\t\n\r -~\xa1-įı-ɏ–-…€]")
_SPECIAL = re.compile(r"<\|\w+\|>")
#: Bytes of text that are cut and looked up at once.
SLICE = 4 << 20
#: White space of plain texts, and bytes that may belong to a character outside the plain set.
SPACE, SUSPECT = np.zeros(256, bool), np.zeros(256, bool)
SPACE[[0x09, 0x0A, 0x0D, 0x20]] = True
SUSPECT[:0x20] = SUSPECT[0xC9:] = True
SUSPECT[[0x7F, 0xC2, 0xC4]] = True
SUSPECT[[0x09, 0x0A, 0x0D]] = False
#: Words of vocabularies with this pattern end before a point that follows a letter.
_LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER, POINT = np.zeros(256, bool), np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
POINT[list(b".,;:!?")] = True


class ChunkEncoder:
    """Encodes lists of texts; `spaces` says whether white space before a word matters."""

    def __init__(self, path: str, spaces: bool):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.spaces = spaces
        special = [(t.content, i) for i, t in self.tok.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark = special[0] if special else None
        steps = json.loads(self.tok.to_str())
        before, cuts = (x.get(k, [x]) if x else [] for x, k in ((steps["normalizer"], "normalizers"), (steps["pre_tokenizer"], "pretokenizers")))
        self.apart = bool(cuts) and cuts[0].get("pattern") == {"Regex": _LETTERS_APART}
        self.lower = any(x["type"] == "Lowercase" for x in before)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, and the number of each; a special string parts them in one call."""
        if self.mark is None:
            ids = [e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        joined = [self.mark[0].join(chunks[lo : lo + 500]) for lo in range(0, len(chunks), 500)]
        flat = [np.array([*e.ids, self.mark[1]], np.uint32) for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(flat)
        end = np.flatnonzero(ids == self.mark[1])
        return ids[ids != self.mark[1]], np.diff(end, prepend=-1) - 1

    def learn(self, chunks: list[str]) -> None:
        ids, lens = self.chunk_ids(chunks)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        k, n = len(self.index), len(chunks)
        if k + n > len(self.start):
            more = max(len(self.start), n)
            self.start, self.size = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.start, self.size))
        self.start[k : k + n] = self.used + np.cumsum(lens) - lens
        self.size[k : k + n] = lens
        self.index.update(zip(chunks, range(k, k + n), strict=True))
        self.used += len(ids)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of each text; a null is empty."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        data, offsets = buffer_of(texts)
        odd = np.flatnonzero(self.odd(texts, data, offsets))
        lens = np.zeros(len(texts), np.int64)
        if not odd.size:
            parts = [self.encode_plain(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets, SLICE)]
            lens = np.concatenate([n for _, n in parts]) if parts else lens
            return np.concatenate([ids for ids, _ in parts]) if parts else np.zeros(0, np.uint32), lens
        plain = np.ones(len(texts), bool)
        plain[odd] = False
        ids, lens[plain] = self.encode(texts.filter(pa.array(plain)))
        whole: list[np.ndarray] = []
        for lo in range(0, len(odd), 64):
            got = self.tok.encode_batch_fast(texts.take(pa.array(odd[lo : lo + 64])).to_pylist(), add_special_tokens=False)
            whole += [np.array(e.ids, np.uint32) for e in got]
        lens[odd] = list(map(len, whole))
        out = np.zeros(int(lens.sum()), np.uint32)
        inside = np.repeat(plain, lens)
        out[inside], out[~inside] = ids, np.concatenate(whole)
        return out, lens

    def odd(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text must be encoded whole: only those with a suspect byte are looked at."""
        at = SUSPECT[data]
        at[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        seen = np.unique(np.searchsorted(offsets, np.flatnonzero(at), "right") - 1)
        out = np.zeros(len(texts), bool)
        for i in seen.tolist():
            t = texts[i].as_py()
            out[i] = bool(_ODD.search(t) or ("<|" in t and _SPECIAL.search(t)))
        return out

    def encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain texts: chunks are cut by their bytes and looked up once each."""
        space = SPACE[data]
        if self.spaces:  # a chunk begins with a text or with a run of white space
            first = space.copy()
            first[1:] &= ~space[:-1]
            first[offsets[:-1][np.diff(offsets) > 0]] = True
            start = np.flatnonzero(first)
            edge = np.append(start, len(data))
        else:  # a chunk is a word
            first = ~space
            first[1:] &= space[:-1]
            edges = offsets[:-1][np.diff(offsets) > 0]
            first[edges] = ~space[edges]
            if self.apart:  # and a point after it is a chunk of its own
                first[1:] |= LETTER[data[:-1]] & POINT[data[1:]]
            start = np.flatnonzero(first)
            data = LOWER[data[~space]] if self.lower else data[~space]
            edge = np.append((np.cumsum(~space) - 1)[start], len(data))
        chunks = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        kinds = chunks.dictionary.to_pylist()
        if len(self.index) > MOST_CHUNKS:
            self.index = dict(islice(self.index.items(), FIRST_CHUNKS))
            self.used = int(self.start[FIRST_CHUNKS])
        at = np.fromiter(map(self.index.get, kinds, repeat(-1)), np.int64, len(kinds))
        if (miss := np.flatnonzero(at < 0)).size:
            at[miss] = len(self.index) + np.arange(len(miss))
            self.learn([kinds[i] for i in miss])
        at = at[chunks.indices.to_numpy()]
        size = self.size[at]
        ids = self.flat[ragged(self.start[at], size)]
        edge = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, offsets)]
        return ids, np.diff(edge)


def encoder(path: str, spaces: bool) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    kept = own_cache("chunks")
    if (path, spaces) not in kept:
        kept[path, spaces] = ChunkEncoder(path, spaces)
    return kept[path, spaces]
