"""Words of many texts at once and what is known of them, with numpy on the UTF-8 bytes: no Python object a word."""

from __future__ import annotations

import numpy as np

from edgeloom.llm.bytewords import mix64

#: bytes of a word that its two numbers hold beside its length; words looked up at a time
EXACT, AT_ONCE = 15, 1 << 17
#: longer words are not remembered
_LONGEST = 64
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123), 0xC3, 0xC5]] = _LETTER
_KIND[48:58] = _DIGIT
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of each word of lower-case UTF-8 that ends with white space: 's 't 're 've 'm 'll 'd, runs of letters,
    digits one by one, runs of anything else but white space.

    Letters are those of ASCII, of Latin-1 but for its signs, and œ; all other characters count as signs.
    """
    kind = _KIND[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first, second = data[lead], data[lead + 1]
        kind[lead[(first == 0xC2) & (second == 0xB5)]] = _LETTER
        kind[lead[(first == 0xC3) & ((second == 0x97) | (second == 0xB7))]] = _OTHER
        kind[lead + 1] = kind[lead]
    edge = kind == _DIGIT
    edge[:1] = True
    edge[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(data == 39)
    at = at[edge[at]]
    at = at[kind[at + 1] == _LETTER]
    a, b = data[at + 1], data[at + 2]
    size = np.isin(a, np.frombuffer(b"stmd", np.uint8)) + 2 * (((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108)))
    at, size = at[size > 0], size[size > 0]
    edge[at + 1] = False
    edge[at + 1 + size] = True
    start = np.flatnonzero(edge)
    size = np.diff(start, append=len(data))
    word = kind[start] != _SPACE
    return start[word], size[word]


class WordTable:
    """The ids of words. `segment`: distinct words -> the ids of each as little-endian unsigned 32-bit numbers.

    A word of up to EXACT bytes is known by two numbers that hold all its bytes and its size, so that different words
    never meet; longer ones by their bytes. When `most` words or `most_ids` ids are held, all are forgotten and the words
    at hand learnt again: which words are known changes nothing.
    """

    def __init__(self, segment, most: int = 300_000, most_ids: int = 1 << 21):
        self.segment, self.most, self.most_ids = segment, most, most_ids
        self.bits = max(10, int(2 * max(most, AT_ONCE) - 1).bit_length())
        self._forget()

    def _forget(self) -> None:
        room = max(self.most, AT_ONCE) + 1
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.low, self.high = np.zeros(room, np.uint64), np.zeros(room, np.uint64)  # the last row, which -1 reads, is no word's
        self.place, self.count_of = np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.ids, self.used, self.count, self.long = np.zeros(1 << 16, np.uint32), 0, 0, {}

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix64(low ^ high * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each word, -1 of those that are not known."""
        slot = self._slot(low, high)
        found = self.slots[slot]
        at = np.flatnonzero((found >= 0) & ((self.low[found] != low) | (self.high[found] != high)))
        while len(at):  # the slot is another word's: on to the next
            slot[at] = slot[at] + 1 & len(self.slots) - 1
            other = found[at] = self.slots[slot[at]]
            at = at[(other >= 0) & ((self.low[other] != low[at]) | (self.high[other] != high[at]))]
        return found

    def _enter(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        self.low[number], self.high[number] = low, high
        slot = self._slot(low, high)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            left = self.slots[slot] != number
            slot, number = slot[left] + 1 & len(self.slots) - 1, number[left]

    def _learn(self, words: list[str]) -> None:
        """The words get the next numbers."""
        found = self.segment(words)
        new = np.frombuffer(b"".join([found[w] for w in words]), np.uint32)
        sizes = np.fromiter((len(found[w]) // 4 for w in words), np.int64, len(words))
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(new), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        own = slice(self.count, self.count + len(words))
        self.place[own], self.count_of[own] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + len(new), self.count + len(words)

    def _numbers(self, raw: bytes, start: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The numbers of the words, all of which are known then."""
        found = self._find(low, high)
        beyond = np.flatnonzero(size > EXACT).tolist()
        texts = [raw[start[i] : start[i] + size[i]] for i in beyond]
        found[beyond] = [self.long.get(t, -1) for t in texts]
        new = np.flatnonzero(found < 0)
        if not len(new):
            return found
        new_long = list({t for t in texts if t not in self.long})
        new = new[size[new] <= EXACT]
        order = new[np.lexsort((low[new], high[new]))]
        first = np.ones(len(order), bool)
        first[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        one = order[first]
        if self.count and (self.count + len(one) + len(new_long) > self.most or self.used > self.most_ids):
            self._forget()
            return self._numbers(raw, start, size, low, high)
        before = self.count
        ends = (start[one] + size[one]).tolist()
        self._learn([raw[s:e].decode() for s, e in zip(start[one].tolist(), ends, strict=True)] + [t.decode() for t in new_long])
        found[order] = before + np.cumsum(first) - 1
        self._enter(low[one], high[one], np.arange(before, before + len(one), dtype=np.int32))
        if beyond:
            self.long.update(zip(new_long, range(before + len(one), self.count), strict=True))
            found[beyond] = [self.long[t] for t in texts]
            for t in new_long:
                if len(t) > _LONGEST:
                    del self.long[t]
        return found

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, which is lower-case UTF-8."""
        raw = b"\n".join(texts) + b"\n" + bytes(16)
        padded = np.frombuffer(raw, np.uint8)
        n = len(raw) - 16
        eight = np.ndarray(n + 9, np.dtype("<u8"), padded, strides=(1,))
        start, size = word_bounds(padded[:n])
        ids, ends = [], np.zeros(len(start) + 1, np.int64)
        for at in range(0, len(start), AT_ONCE):
            s, m = start[at : at + AT_ONCE], size[at : at + AT_ONCE]
            low = eight[s] & _FIRST[np.minimum(m, 8)]
            high = eight[s + 8] & _FIRST[np.clip(m - 8, 0, 7)] | np.minimum(m, EXACT + 1).astype(np.uint64) << np.uint64(56)
            number = self._numbers(raw, s, m, low, high)
            k = self.count_of[number].astype(np.int64)
            before = np.cumsum(k) - k
            ids.append(self.ids[np.arange(k.sum()) + np.repeat(self.place[number] - before, k)])
            ends[at + 1 : at + 1 + len(s)] = ends[at] + before + k
        joined = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = ends[np.searchsorted(start, bounds)].tolist()
        return [joined[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
