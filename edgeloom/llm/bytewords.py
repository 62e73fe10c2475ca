"""Words of many texts at once as 64-bit hashes, with numpy on the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def hash_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its length in bytes, first word of each text (n + 1 bounds), the joined bytes).

    A word is a run of bytes other than 0x20 and 0x09 to 0x0D; A-Z count as a-z if `lower`.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    raw = data
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(n, _P), out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * powers(n, _PINV)[starts])
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    return hashes, ends - starts, np.searchsorted(starts, at), raw


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct hashes of all runs of `width` words; fewer words make one run; none make none."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    total = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j : n - k + 1 + j]
    return np.unique(mix64(total))
