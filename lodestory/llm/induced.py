"""Suffix arrays by induced sorting, in numpy.

Suffixes are classified, leftmost-smaller substrings are sorted by inducing, named, and sorted
recursively until all names differ, and the whole order is induced from them. A sweep does not
turn letter by letter: it takes the longest stretch of places that are final, whatever buckets
they lie in, induces from all of them at once and goes on where a place still waits. Runs of
one letter, which would induce into their own bucket, are laid out together when their bucket
is reached.
"""

from __future__ import annotations

import numpy as np

#: Places that a sweep looks at in one step, at most and at least.
WIDEST, NARROWEST = 1 << 17, 256


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of all suffixes of t in order; letters 0..sigma-1, the last one 0 and nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller, lms = classify(t)
    sa = induce(t, smaller, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = sa[is_lms[sa]]
    names = substring_names(t, lms, by_substring)
    if names[-1] + 1 < len(lms):
        reduced = np.empty(n, np.int64)
        reduced[by_substring] = names
        reduced = reduced[lms]
        kinds = int(names[-1]) + 1
        by_substring = lms[suffix_array(reduced, kinds)]
    return induce(t, smaller, by_substring, sigma)


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are smaller than their right neighbour, and the leftmost of each such run."""
    n = len(t)
    at = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = (t[:-1] < t[1:])[at]
    return smaller, np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def substring_names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the sorted leftmost-smaller substrings, equal ones alike."""
    size = np.empty(len(t), np.int64)
    size[lms] = np.diff(lms, append=len(t) - 1) + 1
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(size[a] == size[b])
    equal = np.zeros(len(a), bool)
    d = 0
    while len(same):
        same = same[t[a[same] + d] == t[b[same] + d]]
        d += 1
        done = size[a[same]] == d
        equal[same[done]] = True
        same = same[~done]
    return np.concatenate(([0], np.cumsum(~equal)))


def induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """All suffixes sorted from the order of the leftmost-smaller ones."""
    n = len(t)
    counts = np.bincount(t, minlength=sigma)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    seeds = np.bincount(t[lms], minlength=sigma)
    by_letter = lms[np.argsort(t[lms], kind="stable")]
    sa[np.repeat(ends - np.cumsum(seeds), seeds) + np.arange(len(lms))] = by_letter
    letter = np.repeat(np.arange(sigma), counts)
    # a bucket's larger suffixes come first, then its smaller ones
    is_large = np.arange(n) < (starts + np.bincount(t[~smaller], minlength=sigma))[letter]
    new = np.concatenate(([True], t[1:] != t[:-1]))
    before = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))  # places of the same run before
    edge = np.append(new[1:], True)  # the last place of a run

    def push(found: np.ndarray, free: np.ndarray, want_smaller: bool) -> None:
        """Put what the suffixes found induce into their buckets, runs' last places only."""
        j = found[found > 0] - 1
        j = j[(smaller[j] == want_smaller) & edge[j]]
        if not len(j):
            return
        turn = np.argsort(t[j], kind="stable")
        j = j[turn]
        kind = t[j]
        first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        many = np.diff(first, append=len(j))
        within = np.arange(len(j)) - np.repeat(first, many)
        if want_smaller:
            sa[free[kind] - 1 - within] = j
            free[kind[first]] -= many
        else:
            sa[free[kind] + within] = j
            free[kind[first]] += many

    def runs(base: np.ndarray) -> np.ndarray:
        """The places before the given last places in their runs: one step back of all, then two, ..."""
        more = before[base]
        owner = np.repeat(np.arange(len(base)), more)
        back = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more) + 1
        turn = np.argsort(back, kind="stable")
        return base[owner[turn]] - back[turn]

    free, p, width = starts.copy(), 0, NARROWEST
    while p < n:
        high = min(n, p + width)
        waits = is_large[p:high] & (sa[p:high] < 0)
        k = int(waits.argmax())
        stop = p + k if waits[k] else high
        if stop == p:
            rest = runs(sa[starts[letter[p]] : p])
            sa[p : p + len(rest)] = rest
            continue
        push(sa[p:stop], free, False)
        width = min(max(2 * (stop - p), NARROWEST), WIDEST)
        p = stop
    sa[~is_large] = -1
    free, p, width = ends.copy(), n, NARROWEST
    while p > 1:  # the end's own place comes last
        low = max(1, p - width)
        waits = (~is_large[low:p] & (sa[low:p] < 0))[::-1]
        k = int(waits.argmax())
        stop = p - k if waits[k] else low
        if stop == p:
            rest = runs(sa[p : ends[letter[p - 1]]][::-1])
            sa[p - len(rest) : p] = rest[::-1]
            continue
        push(sa[stop:p][::-1], free, True)
        width = min(max(2 * (p - stop), NARROWEST), WIDEST)
        p = stop
    sa[0] = n - 1
    return sa


def permuted_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """By text place, the common prefix (up to `most` bytes) of each listed suffix with the one listed
    before it; suffixes need `most` bytes after them. Places that are not listed have -1."""
    out = np.full(len(t), -1, np.int64)
    if not len(order):
        return out
    before = np.full(len(t), -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.sort(order)
    out[place] = 0
    place = place[before[place] >= 0]
    eight = np.ndarray((len(t) - 7,), "<u8", np.ascontiguousarray(t, np.uint8), strides=(1,))
    d = 0
    while len(place) and d < most:
        step = min(d, most - 8)
        x = eight[place + step] ^ eight[before[place] + step]
        miss = x != 0
        low = x[miss] & (~x[miss] + np.uint64(1))
        out[place[miss]] = step + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        place = place[~miss]
        d = step + 8
    out[place] = most
    return out
