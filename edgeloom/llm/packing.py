"""Best-fit packing by minimum bin slack.

Which lengths share a sequence depends only on how many pieces there are of each length: a table of at most `capacity`
numbers. The driver plans from that: per bin, subset-sum over the available lengths in a bitset finds the fullest
feasible combination, which is removed as often as it can be. Every piece then looks its place up by its length and
its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.llm.common import cut, rows_by_bytes, text_of
from edgeloom.llm.lattice import Lattice
from edgeloom.llm.wordtable import WordTable

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: mark of a token that ends a word
END = "</w>"

_SAFE = re.compile("[^\\s!-~¡-¬®-ÿŒœ–—‘’“”…€]", re.A)
_ODD = re.compile("[ªº²³¹¼½¾İ\x1c-\x1f]")


class _ByteLattice(Lattice):
    """Symbols are the bytes of a word; its last one, which ends the word, counts 256 more."""

    def size_of(self, word: str) -> int:
        return len(word.encode())


def _bytes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in words]
    codes, sizes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), np.fromiter(map(len, raw), np.int64, len(raw))
    codes[np.cumsum(sizes) - 1] += np.uint64(256)
    return codes, sizes


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte -> the byte: printable Latin-1 stands for itself, all
    others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}


class Ids:
    """Token ids of texts, word by word: the pre-tokenizer of word_bpe_49k splits words, and a word's ids never depend on its neighbours.

    Texts with characters outside a Latin set, where lower-casing or normalising may look further than one word,
    go through the tokenizer as they are.
    """

    def __init__(self, path: str, most: int = 300_000):
        import json

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()

        def symbols(token: str) -> str:
            word = token.removesuffix(END)
            codes = [letters[c] for c in word]
            return "".join(map(chr, codes if word == token else [*codes[:-1], codes[-1] + 256]))

        ids = {symbols(t): i for t, i in model["vocab"].items() if t.removesuffix(END) and all(c in letters for c in t.removesuffix(END))}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = {(model["vocab"][a], model["vocab"][b]): (rank, model["vocab"][a + b]) for rank, (a, b) in enumerate(pairs)}
        self.words = WordTable(_ByteLattice(ids, merges, _bytes_of).segment, most)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. The words that are new to all of them are learnt at once."""
        whole = [not t.isascii() and bool(_SAFE.search(t)) or "<|" in t or bool(_ODD.search(t)) for t in texts]
        found = self.words([b"" if w else t.lower().encode() for t, w in zip(texts, whole, strict=True)])
        return [self.direct(t) if w else ids for t, w, ids in zip(texts, whole, found, strict=True)]


def _ids(path: str) -> Ids:
    """The Ids of this Python worker: what one task has learnt serves the next."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_edgeloom_ids", {})
    if path not in held:
        held[path] = Ids(path)
    return held[path]


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])


def _pieces(batches, path: str | None, capacity: int):
    ids_of = None
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in rows_by_bytes(batches):
        ids_of = ids_of or _ids(path or _tokenizer_path())
        rows: list[list] = [[] for _ in _PIECES]
        for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist()), strict=True):
            data = ids.tobytes() + b"\0\0\0\0"
            n = len(data) // 4
            for piece, start in enumerate(range(0, n, capacity)):
                length = min(capacity, n - start)
                for column, v in zip(rows, (doc, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), part, int(seen[length])), strict=True):
                    column.append(v)
                seen[length] += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _PIECES, strict=True)], schema=_PIECES)


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """[(length, times)] of the fullest combination of available lengths within `room`; `lengths` falls.

    One bitset holds the sums reached so far; a length with count c enters in about log2(c) shifts. The search ends
    once the room can be filled exactly, else after all lengths; larger pieces are preferred.
    """
    whole, reached, trail = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left, step = min(counts[length], room // length), 1
        while left:
            k = min(step, left)
            trail.append((length, k, reached))
            reached |= (reached << (k * length)) & whole
            left, step = left - k, step * 2
        if reached >> room:
            break
    total, found = reached.bit_length() - 1, {}
    for length, k, before in reversed(trail):
        if not before >> total & 1:
            total -= k * length
            found[length] = found.get(length, 0) + k
    return sorted(found.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of bins, [(length, times)])] that uses up the histogram: minimum bin slack, the largest length first.

    Each step seeds a bin with the largest length left, fills it as far as it can be, and repeats the bin as often as
    the counts allow, so every step takes a length to below its use in the bin: the steps are bounded by the number
    of lengths, not of pieces, up to the logarithm of their multiplicity.
    """
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        rest = fullest(counts, lengths if counts[first] else lengths[1:], capacity - first)
        counts[first] += 1
        use = dict(rest)
        use[first] = use.get(first, 0) + 1
        times = min(counts[k] // n for k, n in use.items())
        out.append((times, sorted(use.items(), reverse=True)))
        for k, n in use.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
                lengths.pop(bisect.bisect_left(lengths, -k, key=lambda x: -x))
    return out


def slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces a bin, first bin, offset of the first in the bin), by rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for times, use in bins:
        at = 0
        for length, n in use:
            rows.setdefault(length, []).append((ranks.get(length, 0), n, base, at))
            ranks[length] = ranks.get(length, 0) + n * times
            at += n * length
        base += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def _place(batches, where: dict[int, np.ndarray]):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for batch in batches:
        c = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
        length, rank = c["length"].to_numpy(zero_copy_only=False), c["rank"].to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for own in np.unique(length):
            rows, table = np.flatnonzero(length == own), where[int(own)]
            k = np.searchsorted(table[:, 0], rank[rows], side="right") - 1
            first, n, base, at = table[k].T
            nth = rank[rows] - first
            sequence[rows], offset[rows] = base + nth // n, at + nth % n * own
        yield pa.RecordBatch.from_arrays([c["doc_id"], c["piece"], c["start"], c["length"], c["ids_crc32"], pa.array(sequence), pa.array(offset)], names)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's token ids and a final 0, cut at `capacity` and packed into few sequences: the rows of op6.

    path: a tokenizer file that every executor can read (None: word_bpe_49k). A null or empty text is the single id 0.
    Equal lengths are ranked by partition and order within it; repeated rows are separate pieces; a null doc_id stays
    null; an empty table gives no rows; other columns are ignored.

    The pieces are tokenised once into the checkpoint folder, so ranks cannot change when an executor is lost. Ranks
    come from counts by (partition, length), so no length, however frequent, gathers in one task.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    pieces = cut(texts.mapInArrow(partial(_pieces, path=path, capacity=capacity), schema))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = cut(counts.withColumn("base", before), 1 + pieces.rdd.getNumPartitions() // 16)  # rows: at most `capacity` a partition
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    ranked = pieces.join(bases.select("part", "length", "base"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(partial(_place, where=slots(plan(histogram, capacity))), out)
