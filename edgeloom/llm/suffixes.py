"""Suffix sorting with numpy, one bucket of suffixes at a time, long ties resolved by the ranks of a difference cover.

D is a difference cover modulo V if every difference modulo V occurs between two of its members. For any two suffixes
i and j there is then a shift below V that takes both onto sampled positions (those that are in D modulo V), so two
suffixes that agree on V bytes are ordered by the ranks of two sampled suffixes. Only len(D) / V of the ranks are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np

#: a perfect difference set: every difference modulo 57 but 0 occurs exactly once
V = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)


def words_at(text: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The k-th 8 bytes of each suffix as a number that sorts as they do; `text` is followed by 8 * (k + 2) zeros at least."""
    view = np.ndarray(len(text) - 7, np.dtype(">u8"), text, strides=(1,))
    return view[starts + 8 * k].astype(np.uint64)


def sort_bucket(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts sorted by their first `depth` bytes, number of each one's class of equal bytes).

    text: uint8, zero-padded by depth + 16 bytes. Only classes that are still tied are looked at again.
    """
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    tied = np.arange(len(starts))  # places in `order` whose class has others
    for k in range(-(-depth // 8)):
        if not len(tied):
            break
        word = words_at(text, starts[order[tied]], k)
        if depth - 8 * k < 8:
            word &= np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(64 - 8 * (depth - 8 * k))
        own = group[tied]
        inner = np.lexsort((word, own))
        order[tied] = order[tied][inner]
        word, own = word[inner], own[inner]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (word[1:] != word[:-1]) | (own[1:] != own[:-1])
        first = np.maximum.accumulate(np.where(fresh, tied, 0))
        group[tied] = first  # a class is named by the place of its first suffix
        alone = fresh & np.append(fresh[1:], True)
        tied = tied[~alone]
    return order, group


class CoverRanks:
    """Ranks of the sampled suffixes of a text, by prefix doubling over the sample."""

    def __init__(self, text: np.ndarray, n: int):
        self.n = n
        inside = np.zeros(V, bool)
        inside[list(COVER)] = True
        at = np.arange(n)
        sample = at[inside[at % V]]
        slot = np.full(V, -1)
        slot[list(COVER)] = np.arange(len(COVER))
        self.slot, width = slot, len(COVER)
        self.rank = np.full((n // V + 2) * width, -1, np.int64)
        self.width = width
        order, group = sort_bucket(text, sample, V)
        name = np.empty(len(sample), np.int64)
        name[order] = group
        name = np.unique(np.stack([name, np.minimum(n - sample, V)]), axis=1, return_inverse=True)[1].ravel()  # padding is no text
        here = self.index(sample)
        self.rank[here] = name
        step = V  # a sampled position plus a multiple of V is sampled
        while len(np.unique(name)) < len(sample):
            later = sample + step
            ok = later < n
            second = np.full(len(sample), -1, np.int64)
            second[ok] = self.rank[self.index(later[ok])]
            order = np.lexsort((second, name))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (name[order][1:] != name[order][:-1]) | (second[order][1:] != second[order][:-1])
            name = name.copy()
            name[order] = np.cumsum(fresh) - 1
            self.rank[here] = name
            step *= 2
        self.shift = {}
        for a in COVER:
            for b in COVER:
                self.shift.setdefault((b - a) % V, a)

    def index(self, at: np.ndarray) -> np.ndarray:
        return at // V * self.width + self.slot[at % V]

    def compare(self, i: int, j: int) -> int:
        """Order of suffixes i and j that agree on V bytes or end before."""
        d = (self.shift[(j - i) % V] - i) % V
        a, b = i + d, j + d
        ra = self.rank[a // V * self.width + self.slot[a % V]] if a < self.n else self.n - a - 1
        rb = self.rank[b // V * self.width + self.slot[b % V]] if b < self.n else self.n - b - 1
        return -1 if ra < rb else 1


def suffix_buckets(data: bytes, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The suffix array of data in consecutive parts: suffixes are split by their first two bytes into ranges of about
    `most`, and one range at a time is sorted. An empty text has no suffixes."""
    n = len(data)
    if not n:
        return
    text = np.zeros(n + V + 24, np.uint8)
    text[:n] = np.frombuffer(data, np.uint8)
    head = text[:n].astype(np.int32) * 256 + text[1 : n + 1]  # the last suffix counts as if followed by 0
    counts = np.bincount(head, minlength=65536)
    ranks = CoverRanks(text, n)
    low = 0
    while low < 65536:
        high, held = low, 0
        while high < 65536 and (held == 0 or held + counts[high] <= most):
            held += counts[high]
            high += 1
        if held:
            starts = np.flatnonzero((head >= low) & (head < high))
            order, group = sort_bucket(text, starts, V)
            out = starts[order]
            edges = np.flatnonzero(np.append(np.diff(group) != 0, True))
            begin = 0
            for end in (edges + 1).tolist():
                if end - begin > 1:
                    out[begin:end] = sorted(out[begin:end].tolist(), key=cmp_to_key(ranks.compare))
                begin = end
            yield out
        low = high


def suffix_array(data: bytes) -> np.ndarray:
    parts = list(suffix_buckets(data))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
