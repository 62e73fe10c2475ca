"""A lattice of pieces whose fold gives the segmentation of a byte-pair encoding.

Every piece that occurs in a word is an edge from its start to its end. Of all paths through a word only that of the
encoding has compatible neighbours throughout (two pieces are compatible if the merges leave them as they are side by
side), so the fold keeps, for each end, the one edge that is compatible with the edge before it. Words advance together,
one end after the other, in numpy.
"""

from __future__ import annotations

import numpy as np

from edgeloom.llm.bytewords import mix64

#: slots of a hash table; longest word that is folded beside others; words folded together
_SLOTS, _SIDE, _AT_ONCE = 1 << 20, 64, 8_000


def _hash(codes: np.ndarray, before: np.ndarray | None) -> np.ndarray:
    """The hash of a substring from that of the substring without its last symbol, and this."""
    return mix64((codes if before is None else before * np.uint64(0x9E3779B97F4A7C15) + codes) + np.uint64(0x632BE59BD9B4E019))


class Lattice:
    """pieces: text -> id, a text's symbols being its code points. merges: (id, id) -> (rank, id of both together), the
    smaller rank first. `coded`: words -> (symbols of all, number of each word's). `bare`: the ids of a symbol that no
    piece begins with, as bytes."""

    def __init__(self, pieces: dict[str, int], merges: dict[tuple[int, int], tuple[int, int]], coded, bare=None):
        self.text = {i: p for p, i in pieces.items()}
        self.ids, self.coded, self.bare = pieces, coded, bare
        self.longest = max(map(len, pieces))
        self.split: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        reached = [i for p, i in pieces.items() if self._reached(p, i, merges)]
        self._index_prefixes([self.text[i] for i in reached], reached)
        self._index_pairs(merges)
        del self.text, self.ids, self.split, self.rank  # arrays hold what they said

    def size_of(self, word: str) -> int:
        return len(word)

    def _index_prefixes(self, pieces: list[str], ids: list[int]) -> None:
        """Hash tables of every beginning of a piece; a beginning that is a piece has its id, others -1."""
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)}, key=len)
        place = {p: k for k, p in enumerate(prefixes)}
        self.hashes = np.zeros(len(prefixes), np.uint64)
        for k in range(1, len(prefixes[-1]) + 1 if prefixes else 1):
            own = [i for i, p in enumerate(prefixes) if len(p) == k]
            last = np.array([ord(prefixes[i][-1]) for i in own], np.uint64)
            before = self.hashes[[place[prefixes[i][:-1]] for i in own]] if k > 1 else None
            self.hashes[own] = _hash(last, before)
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two beginnings of pieces share a hash")
        self.piece_of = np.full(len(prefixes) + 1, -1, np.int32)
        self.piece_of[[place[p] for p in pieces]] = ids
        self.tables, left = [], np.arange(len(prefixes))
        while len(left):  # what finds its slot taken goes to a further table, by other bits
            shift = np.uint64(44 - 7 * len(self.tables))
            slots = (self.hashes[left] >> shift & np.uint64(_SLOTS - 1)).astype(np.int64)
            held = np.full(_SLOTS, len(prefixes), np.int32)
            held[slots] = left
            self.tables.append((shift, held))
            left = left[held[slots] != left]
        self.hashes = np.append(self.hashes, np.uint64(0))

    def _index_pairs(self, merges) -> None:
        """Ranks, last merges and joined pieces as arrays, and an empty memory of compatible pairs."""
        top = max(self.text) + 1
        self.ranks, self.halves = np.full(top, 1 << 40, np.int64), np.full((top, 2), -1, np.int64)
        for i, halves in self.split.items():
            self.halves[i], self.ranks[i] = halves, self.rank[i]
        joins = sorted((a << 20 | b, r) for (a, b), (r, _) in merges.items())
        self.pairs, self.pair_rank = np.array([*(j[0] for j in joins), 1 << 62], np.int64), np.array([*(j[1] for j in joins), 1 << 41], np.int64)
        self.pair_key, self.pair_good = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, bool)

    def _reached(self, piece: str, own: int, merges) -> bool:
        """Whether the merges make the piece from its symbols; the last of them is kept."""
        parts = [self.ids.get(c) for c in piece]
        if None in parts and len(parts) > 1:
            return False
        while len(parts) > 1:
            best = min(((merges[pair][0], k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in merges), default=None)
            if best is None:
                return False
            k = best[1]
            joined = merges[parts[k], parts[k + 1]][1]
            if len(parts) == 2:
                self.split[own], self.rank[own] = (parts[0], parts[1]), best[0]
            parts[k : k + 2] = [joined]
        return True

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the pieces a and b as they are when b follows a: the merges inside are undone from the last,
        and none across them may come before the one undone."""
        good, at, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 40, np.int64)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(at):
            key = a << 20 | b
            k = np.searchsorted(self.pairs, key)
            bad = (self.pairs[k] == key) & (self.pair_rank[k] < limit)
            good[at[bad]] = False
            ra, rb = self.ranks[a], self.ranks[b]
            left, right = self.halves[a, 0] >= 0, self.halves[b, 0] >= 0
            undo_a = left & ((ra > rb) | ~right)  # of equal merges the left is made first
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.halves[a, 1], a), np.where(undo_a | ~right, b, self.halves[b, 0])
            on = ~bad & (undo_a | right)
            at, a, b, limit = at[on], a[on], b[on], limit[on]
        return good

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """compatible(), remembered in a table of a fixed size: a pair overwrites another in its slot."""
        key = before.astype(np.int64) << 20 | piece
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        good, new = self.pair_good[slot], np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            keys, of = np.unique(key[new], return_inverse=True)
            found = self.compatible(keys >> 20, keys & 0xFFFFF)
            good[new] = found[of]
            self.pair_key[slot[new]], self.pair_good[slot[new]] = key[new], good[new]
            last = self.pair_key[slot[new]] == key[new]  # of two pairs that meet in a slot, one is kept, with its value
            self.pair_good[slot[new[last]]] = good[new[last]]
        return good

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, start, end, piece) of every piece that occurs in the words, by end; of one end by start, then word."""
        codes, sizes = self.coded(words)
        first = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(words)), sizes)
        room = (first + sizes)[of] - np.arange(len(codes))
        at, h, found = np.arange(len(codes)), None, []
        for n in range(1, self.longest + 1):
            stay = room[at] >= n
            if n > 1:
                stay &= node < len(self.hashes) - 1  # noqa: F821  what begins no piece goes no further
                h = h[stay]
            at = at[stay]
            if not len(at):
                break
            h = _hash(codes[at + (n - 1)], h)
            node = self._find(h)
            piece = self.piece_of[node]
            hit = np.flatnonzero(piece >= 0)
            found.append((at[hit], n, piece[hit]))
        found.reverse()
        start, piece = np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])
        word = of[start]
        start -= first[word]
        end = start + np.repeat([f[1] for f in found], [len(f[0]) for f in found])
        order = np.argsort(end.astype(np.uint16) if len(end) and end.max() < 65536 else end, kind="stable")
        return word[order], start[order], end[order], piece[order]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash's beginning of a piece, or that of none."""
        mask, none = np.uint64(_SLOTS - 1), len(self.hashes) - 1
        shift, held = self.tables[0]
        node = held[(h >> shift & mask).astype(np.int64)]
        wrong = np.flatnonzero((self.hashes[node] != h) & (node != none))  # an empty slot of the first table: in no other
        node[wrong] = none
        for shift, held in self.tables[1:]:
            other = held[(h[wrong] >> shift & mask).astype(np.int64)]
            right = self.hashes[other] == h[wrong]
            node[wrong[right]] = other[right]
            wrong = wrong[~right]
        return node

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each of the distinct non-empty words, as little-endian unsigned 32-bit numbers."""
        found: dict[str, bytes] = {}
        for at in range(0, len(words), _AT_ONCE):
            self._segment(words[at : at + _AT_ONCE], found)
        return found

    def _segment(self, words: list[str], found: dict[str, bytes]) -> None:
        words = sorted(words, key=self.size_of, reverse=True)
        long = next((k for k, w in enumerate(words) if self.size_of(w) <= _SIDE), len(words))
        for w in words[:long]:
            found[w] = self._long(w)
        words = words[long:]
        if not words:
            return
        sizes = np.fromiter(map(self.size_of, words), np.int64, len(words))
        word, start, end, piece = self.edges(words)
        top = int(sizes[0])
        last, back = np.full((top + 1, len(words)), -1, np.int32), np.zeros((top + 1, len(words)), np.int32)
        last[0] = -2
        bounds = np.searchsorted(end, np.arange(1, top + 2))
        many = np.searchsorted(-sizes, -np.arange(top + 1), side="right")  # words of at least so many characters
        for e in range(1, top + 1):
            own = slice(bounds[e - 1], bounds[e])
            w, s, p = word[own], start[own], piece[own]
            before = last[s, w]
            ok = before == -2
            ask = np.flatnonzero(~ok)
            ok[ask] = self._fits(before[ask], p[ask])
            ok = np.flatnonzero(ok)[::-1]  # of several the earliest start is written last
            last[e, w[ok]], back[e, w[ok]] = p[ok], s[ok]
            bare = np.flatnonzero(last[e, : many[e]] == -1)  # a character without a piece
            last[e, bare], back[e, bare] = -2, e - 1
        steps, at, on = [], sizes.copy(), np.arange(len(words))
        while len(on):
            steps.append((on, last[at[on], on]))
            at[on] = back[at[on], on]
            on = on[at[on] > 0]
        n = np.bincount(np.concatenate([s[0] for s in steps]), minlength=len(words))
        ends = np.cumsum(n)
        flat, bytewise = np.zeros(ends[-1], np.uint32), np.zeros(len(words), bool)
        for k, (on, ids) in enumerate(steps):
            flat[ends[on] - 1 - k] = ids
            bytewise[on[ids == -2]] = True
        raw, cuts = flat.tobytes(), (4 * ends).tolist()
        found.update(zip(words, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
        for k in np.flatnonzero(bytewise).tolist():
            own, x = [], len(words[k])
            while x:
                s = int(back[x, k])
                own.append(self._ids_of(int(last[x, k]), words[k], s))
                x = s
            found[words[k]] = b"".join(reversed(own))

    def _ids_of(self, piece: int, word: str, at: int) -> bytes:
        return piece.to_bytes(4, "little") if piece >= 0 else self.bare(word[at])

    def _long(self, w: str) -> bytes:
        """The ids of one word of any length: what is held grows with its length only."""
        n = self.size_of(w)
        last, back, done = [-1] * (n + 1), [0] * (n + 1), 0
        last[0] = -2
        good: dict[int, bool] = {}
        for s, e, p in zip(*(x.tolist() for x in self.edges([w])[1:]), strict=True):
            if e > done + 1:
                for x in range(done + 1, e):  # characters without a piece
                    last[x], back[x] = -2, x - 1
                done = e - 1
            if done >= e:
                continue
            before = last[s]
            if before != -2:
                pair = before << 20 | p
                if pair not in good:
                    good[pair] = bool(self._fits(np.array([before]), np.array([p]))[0])
                if not good[pair]:
                    continue
            last[e], back[e], done = p, s, e
        for x in range(done + 1, n + 1):
            last[x], back[x] = -2, x - 1
        ids, x = [], n
        while x:
            ids.append(self._ids_of(last[x], w, back[x]))
            x = back[x]
        return b"".join(reversed(ids))


class Remembered:
    """The ids of words, learnt a slice of texts at a time; at most `most` words are held, and which are changes nothing."""

    def __init__(self, lattice: Lattice, most: int):
        self.lattice, self.most, self.known = lattice, most, {}

    def __call__(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The ids of each list of words."""
        every = set().union(*lists)
        new = list(every.difference(self.known))
        if new:
            if len(self.known) + len(new) > self.most:
                self.known = {k: self.known[k] for k in every.intersection(self.known)}  # what this slice uses again
            self.known.update(self.lattice.segment(new))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.uint32) for words in lists]
