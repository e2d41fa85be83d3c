"""Suffix arrays by two-stage sorting, in whole-array steps."""

from __future__ import annotations

import numpy as np


def words_at(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number (zeros after the end)."""
    n = len(t)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = t
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        count = (n - r + 7) // 8
        out[r::8] = padded[r : r + 8 * count].view(">u8")
    return out


def _sorted_by_prefix(at: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next `depth` bytes, eight at a time; only ties are looked at again."""
    order = np.argsort(word[at], kind="stable")
    at = at[order]
    group = np.cumsum(np.r_[True, word[at[1:]] != word[at[:-1]]]) - 1 if len(at) else np.empty(0, np.int64)
    for step in range(8, depth, 8):
        tied = np.r_[False, group[1:] == group[:-1]]
        tied |= np.r_[tied[1:], False]
        here = np.flatnonzero(tied)
        if not len(here):
            break
        at_here, group_here = at[here], group[here]
        beyond = at_here + step
        value = np.where(beyond < len(word), word[np.minimum(beyond, len(word) - 1)], 0).astype(np.uint64)
        order = np.lexsort((value, group_here))
        at[here], value, group_here = at_here[order], value[order], group_here[order]
        fresh = np.r_[True, (group_here[1:] != group_here[:-1]) | (value[1:] != value[:-1])]
        # a group is named by the place of its first member, so that names stay in order when it splits
        group[here] = here[np.maximum.accumulate(np.where(fresh, np.arange(len(here)), 0))] + len(at)
        rest = np.flatnonzero(~tied)
        group[rest] = rest + len(at)
        group -= len(at)
    return at


def suffix_array(t: np.ndarray, depth: int, word: np.ndarray | None = None) -> np.ndarray:
    """Positions of t in the order of their suffixes, by `depth` bytes at least (further ties in any order).

    Suffixes that are smaller than their successors are sorted directly. A scan through the buckets of
    first bytes, smallest first, places the others: each stands in its own bucket, before the sorted ones,
    in the order in which its successor is passed.
    """
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    word = words_at(t) if word is None else word
    change = np.flatnonzero(t[1:] != t[:-1])
    after = np.searchsorted(change, np.arange(n))  # the change that ends the run of each position
    smaller = np.zeros(n, bool)
    inside = after < len(change)
    at = change[after[inside]]
    smaller[inside] = t[at] < t[at + 1]
    direct = _sorted_by_prefix(np.flatnonzero(smaller), word, depth)
    bounds = np.searchsorted(t[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        passed = []
        now = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        while len(now):  # a run of c: each step back is placed behind what it comes from
            passed.append(now)
            before = now - 1
            before = before[before >= 0]
            now = before[(t[before] == c) & ~smaller[before]]
        passed.append(direct[bounds[c] : bounds[c + 1]])
        whole = np.concatenate(passed)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[~smaller[before] & (t[before] > c)]
        if len(before):
            kind = t[before]
            order = np.argsort(kind, kind="stable")
            before, kind = before[order], kind[order]
            for part in np.split(before, np.flatnonzero(kind[1:] != kind[:-1]) + 1):
                pending[t[part[0]]].append(part)
    return np.concatenate(out)


def shared_prefixes(sa: np.ndarray, word: np.ndarray, length: int) -> np.ndarray:
    """For each place in sa: whether its suffix and the one before have `length` bytes in common (all of them must have so many)."""
    same = np.zeros(len(sa), bool)
    left = np.arange(1, len(sa))
    for step in [*range(0, length - 8, 8), length - 8]:
        left = left[word[sa[left] + step] == word[sa[left - 1] + step]]
    same[left] = True
    return same
