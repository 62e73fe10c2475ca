"""Removal of byte strings that repeat across documents, by sorting suffixes one bucket at a time.

Sorting every suffix would shuffle many times the text. Suffixes are therefore sampled by content: of the grams in each
window of `length` bytes the smallest hash marks the window's anchor, so equal windows have equally placed anchors
(about one position in seventeen is one). Buckets of anchors tell which are shared between documents. Where the whole
surroundings agree with those in an earlier document, their windows are repeats; where they agree in part, the window
suffixes around the anchor are sorted bucket by bucket to the full depth (edgeloom.llm.suffixes).
"""

from __future__ import annotations

import hashlib
import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.bytewords import _BYTE, _P, _PINV, mix64, powers
from edgeloom.llm.common import cut, discard, rows_by_bytes, text_of, trim
from edgeloom.llm.suffixes import sort_bucket

LENGTH = 50
BLOCK = 3 << 20
CHUNK = 1 << 17
#: bytes of text whose blocks send their entries together, and for which there is one bucket
PACK = 16 << 20
BUCKET = 8 << 20
#: entries and windows that are sorted at a time within a bucket
SLICE = 1 << 17
#: different surroundings of one anchor from which on their windows are spread over buckets
HOT = 4096
_GRAM = 18


class _Held(dict):
    """What a process keeps; it is sent to no other."""

    def __reduce__(self):
        return _Held, ()


_held = _Held()


def _zstd(kind: str, **given):
    import zstandard

    if kind not in _held:
        _held[kind] = getattr(zstandard, kind)(**given)
    return _held[kind]


def squeezed(x) -> bytes:
    return _zstd("ZstdCompressor", level=3).compress(x if isinstance(x, bytes) else pickle.dumps(x, 5))


def loosened(b: bytes):
    return _zstd("ZstdDecompressor").decompress(b)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_held.get("p", ())) < n:
        _held["p"], _held["q"] = powers(n, _P), powers(n, _PINV)
    return _held["p"], _held["q"]


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: lo, hi (window starts, both included), gram (hash of the anchor), around (hash of
    the bytes that the windows cover). Windows lie within the texts that `bounds` separates."""
    gram, chunk = min(_GRAM, length), max(CHUNK, 1 << (4 * length).bit_length())
    span = length - gram + 1
    out: dict[str, list] = {k: [] for k in ("lo", "hi", "gram", "around")}
    n = len(data)
    crossing = np.zeros(n + 1, np.int32)
    np.add.at(crossing, np.maximum(bounds[:-1], bounds[1:] - length + 1), 1)
    np.add.at(crossing, bounds[1:], -1)
    valid = np.cumsum(crossing[:n]) == 0
    for c0 in range(0, max(0, n - length + 1), chunk - length):
        m = min(chunk - length, n - length + 1 - c0)
        piece = data[c0 : c0 + m + length - 1]
        ok = np.flatnonzero(valid[c0 : c0 + m])
        if not len(ok):
            continue
        padded = np.append(piece, np.zeros(8, np.uint8))
        u = np.ndarray(len(piece) + 1, np.dtype("<u8"), padded, strides=(1,)).astype(np.uint64)
        g = len(piece) - gram + 1
        if gram >= 8:
            h = u[:g] * np.uint64(0x9E3779B97F4A7C15)
            for k in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
                h += mix64(u[k : k + g]) * np.uint64(2 * k + 0xD6E8FEB86659FD93)
        else:
            h = u[:g] & np.uint64((1 << 8 * gram) - 1)
        h = mix64(h)
        low = h & ~np.uint64(chunk - 1) | np.arange(g, dtype=np.uint64)
        width = 1
        while 2 * width <= span:  # low: the minimum of `width` grams from each
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:m], low[span - width : span - width + m])
        at = (low & np.uint64(chunk - 1)).astype(np.int64)[ok]
        new = np.ones(len(ok), bool)
        new[1:] = (np.diff(ok) != 1) | (np.diff(at) != 0)
        first = np.flatnonzero(new)
        lo, hi = ok[first], ok[np.append(first[1:], len(ok)) - 1]
        p, q = _powers(chunk)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * p[: len(piece)], out=total[1:])
        around = mix64((total[hi + length] - total[lo]) * q[lo] + (hi - lo).astype(np.uint64))
        for k, v in zip(out, (lo + c0, hi + c0, h[at[first]], around), strict=True):
            out[k].append(v)
    kinds = {"lo": np.int64, "hi": np.int64, "gram": np.uint64, "around": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in out.items()}


class Block:
    """Some documents, by rising doc_id, with the distinct (anchor, surroundings) in them as numbered entries."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, text: bytes, length: int, buckets: int):
        self.ids, self.bounds, self.length = ids, bounds, length
        self.data = np.frombuffer(text, np.uint8)
        r = anchors(self.data, bounds, length)
        self.lo, self.hi = r["lo"], r["hi"]
        self.doc = np.searchsorted(bounds, self.lo, side="right") - 1
        _, self.first, self.entry = np.unique(mix64(r["gram"]) ^ r["around"], return_index=True, return_inverse=True)
        self.entry = self.entry.ravel()
        gram = r["gram"][self.first]
        self.gram, self.around = (gram >> np.uint64(32)).astype(np.uint32), r["around"][self.first]
        self.smallest = ids[self.doc[self.first]]  # runs are in the order of doc_id
        bucket = (gram & np.uint64(0xFFFFFFFF)).astype(np.int64) % buckets
        self.order = np.lexsort((self.first, bucket))
        self.buckets, edges = np.unique(bucket[self.order], return_index=True)  # those that the block has entries in
        self.edges = np.append(edges, len(bucket))


def buckets_for(size: int) -> int:
    """How many buckets a corpus of `size` bytes has."""
    return max(32, -(-size // BUCKET))


def _pack_blocks(batches):
    import uuid

    pack, place, held_bytes = uuid.uuid4().hex, 0, 0
    for part in rows_by_bytes(batches, "text", BLOCK, 10_000):
        ids = part.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        texts = part.column(1)
        raw = [texts[i].as_buffer().to_pybytes() for i in order.tolist()]
        size = sum(map(len, raw))
        if place and held_bytes + size > PACK:
            pack, place, held_bytes = uuid.uuid4().hex, 0, 0
        held = pickle.dumps((ids[order], np.cumsum([0, *map(len, raw)]), b"".join(raw)), 5)
        yield pa.RecordBatch.from_pydict({"pack": [pack], "place": pa.array([place], pa.int32()), "bytes": [size], "data": [squeezed(held)]})
        place, held_bytes = place + 1, held_bytes + size


def _sent(pack: str, blocks: list) -> pa.RecordBatch:
    """One row for each bucket with the entries of all blocks of a pack, block by block. Takes what is in `blocks`."""
    place = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(b[0]) for b in blocks])
    columns = list(zip(*blocks, strict=True))
    blocks.clear()
    order = np.argsort(np.concatenate(columns[0]), kind="stable").astype(np.int32)
    place = place[order]
    bucket, gram, around, docs = (np.concatenate(columns.pop(0))[order] for _ in range(4))
    part = np.flatnonzero(starts_of(bucket, place))  # of one block in one bucket, by rising doc_id
    steps = np.diff(docs, prepend=docs[:1])
    steps[part] = 0
    counts, bases = np.diff(np.append(part, len(bucket))), docs[part]
    del place, order, docs
    edges = np.append(np.flatnonzero(starts_of(bucket)), len(bucket))
    of_row = np.searchsorted(part, edges).tolist()
    used, rows, edges = bucket[edges[:-1]], [], edges.tolist()
    for s, t, i, j in zip(edges, edges[1:], of_row, of_row[1:], strict=False):
        short = bool(0 <= steps[s:t].min() and steps[s:t].max() < 65536)
        own = squeezed(steps[s:t].astype(np.uint16 if short else np.int64).tobytes())
        rows.append(pickle.dumps((gram[s:t].tobytes(), around[s:t].tobytes(), counts[i:j].tobytes(), bases[i:j].tobytes(), short, own), 5))
    return pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "pack": [pack] * len(rows), "data": pa.array(rows, pa.binary())})


def _docs_of(row: tuple) -> np.ndarray:
    """The doc_ids of a row of _sent."""
    _, _, counts, bases, short, steps = row
    counts, bases = np.frombuffer(counts, np.int64), np.frombuffer(bases, np.int64)
    total = np.cumsum(np.frombuffer(loosened(steps), np.uint16 if short else np.int64), dtype=np.int64)
    return total + np.repeat(bases - total[np.cumsum(counts) - counts], counts)


def _entries(batches, length: int, buckets: int):
    """Of each pack, for each bucket: anchors (32 bits of a hash, beside those that chose the bucket), surroundings (64
    bits), smallest doc_ids. With b bytes of text there are about b / 17 entries, and the chance that any two different
    ones share all bits is below b^2 / 2^105 / (number of buckets): one in 10^9 at 100 TB.

    A row for each block of 3 MB and bucket of 2 MB would be 170 a MB of text at 1 GB, and 1700 at 10 GB; with packs of 16 MB
    and buckets of 8 MB they are 8 and 80."""
    current, held = None, []
    for batch in batches:
        for pack, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if pack != current:
                if held:
                    yield _sent(current, held)
                current, held = pack, []
            b = Block(*pickle.loads(loosened(data.as_buffer().to_pybytes())), length, buckets)
            if len(b.order):
                held.append((np.repeat(b.buckets.astype(np.int32), np.diff(b.edges)), b.gram[b.order], b.around[b.order], b.smallest[b.order]))
            del b
            trim()  # the next block's work and _sent would take more beside it
    if held:
        yield _sent(current, held)
    trim()


def _runs(batches, keys: int):
    """(key, [rows]) of batches sorted by their first `keys` columns. Memory is trimmed after the last."""
    current, held = None, []
    for batch in batches:
        columns = [c.to_pylist() if not pa.types.is_binary(c.type) else c for c in batch.columns]
        for row in zip(*columns, strict=True):
            key = row[:keys]
            if key != current:
                if held:
                    yield current, held
                current, held = key, []
            held.append([x.as_buffer().to_pybytes() if isinstance(x, pa.BinaryScalar) else x for x in row[keys:]])
    if held:
        yield current, held
    del held
    trim()


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def slices_of(key: np.ndarray, weight: np.ndarray, most: int):
    """Ranges (from, to) of a sorted key: no key is in two of them, and each weighs about `most`, one key at least."""
    if not len(key):
        return
    at = np.flatnonzero(starts_of(key))
    before = (np.cumsum(weight) - weight)[at]
    first = at[starts_of(before // most)].tolist()
    yield from zip(first, [*first[1:], len(key)], strict=True)


def _flags_of(gram: np.ndarray, around: np.ndarray, doc: np.ndarray) -> np.ndarray:
    key = gram.astype(np.uint64) << np.uint64(32) | around >> np.uint64(32)
    order = np.argsort(key)
    key, a = key[order], around[order]
    if np.any((key[1:] == key[:-1]) & (a[1:] != a[:-1])):
        order = np.lexsort((around, gram))
        a = around[order]
    g, d = gram[order], doc[order]
    entry, anchor = starts_of(g, a), starts_of(g)
    least = np.minimum.reduceat(d, np.flatnonzero(entry))[np.cumsum(entry) - 1]
    of, at = np.cumsum(anchor) - 1, np.flatnonzero(anchor)
    kinds = np.add.reduceat(entry.astype(np.int64), at)
    mixed = (np.minimum.reduceat(least, at) < np.maximum.reduceat(least, at)) & (kinds > 1)
    found = np.empty(len(order), np.uint8)
    found[order] = np.where(d > least, 1, np.where(mixed[of], np.where(kinds[of] >= HOT, 3, 2), 0))
    return found


def _shared(batches):
    """One bucket of anchors at a time: which entries of which pack repeat an earlier document's.

    1: another block has the entry with a smaller doc_id. 2, 3: this is the entry's first document (in each block that
    holds rows of it), and other documents have the anchor in other surroundings (3: in HOT or more).
    """
    for (bucket,), rows in _runs(batches, 1):
        parts = [pickle.loads(data) for _, data in rows]
        doc = np.concatenate([_docs_of(p) for p in parts])
        gram = np.frombuffer(b"".join(p[0] for p in parts), np.uint32)
        around = np.frombuffer(b"".join(p[1] for p in parts), np.uint64)
        sizes = [len(p[0]) // 4 for p in parts]
        del parts
        head = (gram >> np.uint32(16)).astype(np.uint16)
        by = np.argsort(head, kind="stable")
        found = np.zeros(len(gram), np.uint8)
        for s, t in slices_of(head[by], np.ones(len(by), np.int64), SLICE):
            own = by[s:t]
            found[own] = _flags_of(gram[own], around[own], doc[own])
        at = 0
        for (pack, _), n in zip(rows, sizes, strict=True):
            own = found[at : at + n]
            at += n
            if own.any():
                yield pa.RecordBatch.from_pydict({"pack": [pack], "bucket": pa.array([bucket], pa.int32()), "data": [squeezed(own.tobytes())]})


def _digest(ids, bounds, data: np.ndarray, cover: np.ndarray, picked, texts: bool) -> tuple:
    """Per document: n_bytes, n_removed, n_spans, digest of what is kept (and, of changed ones, the kept text, cut at
    characters, and the digest of the whole text)."""
    out: list[list] = [[] for _ in range(7)]
    hit = np.add.reduceat(np.append(cover, False).astype(np.int64), bounds[:-1]) if len(bounds) > 1 else []
    for i in picked:
        s, e = int(bounds[i]), int(bounds[i + 1])
        own = cover[s:e]
        removed = int(hit[i]) if e > s else 0
        if removed:
            spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + bool(own[0])
            kept = data[s:e][~own].tobytes()
        else:
            spans, kept = 0, data[s:e].tobytes()
        text = whole = None
        if texts and removed:  # a character goes only if all its bytes do
            head = (data[s:e] & 0xC0) != 0x80
            stays = np.logical_or.reduceat(~own, np.flatnonzero(head))
            text = data[s:e][stays[np.cumsum(head) - 1]].tobytes().decode("utf-8", "replace")
            whole = hashlib.md5(data[s:e]).hexdigest()
        for column, v in zip(out, (int(ids[i]), e - s, removed, spans, hashlib.sha256(kept).hexdigest(), text, whole), strict=True):
            column.append(v)
    return tuple(out)


_STEP = pa.schema([("kind", pa.int32()), ("pack", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())])


def _cover(n: int, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + length, -1)
    return np.cumsum(change[:n]) > 0


def _step(pack: str, rows: list) -> pa.RecordBatch:
    kinds, where, datas = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([pack] * len(rows)), pa.array(where, pa.int32()), pa.array(datas, pa.binary())], schema=_STEP)


def _windows(sent: list) -> list:
    """What the blocks of a pack send to be sorted, one row for each bucket. Takes what is in `sent`."""
    columns = list(zip(*sent, strict=True))
    sent.clear()
    texts = [x for held in columns.pop() for x in held]
    where = np.concatenate(columns.pop())
    order = np.argsort(where, kind="stable")
    where, columns = where[order], [np.concatenate(c)[order] for c in columns]
    edges, order = np.append(np.flatnonzero(starts_of(where)), len(where)).tolist(), order.tolist()
    return [(2, int(where[s]), squeezed((*(c[s:t] for c in columns), b"".join([texts[i] for i in order[s:t]])))) for s, t in zip(edges, edges[1:], strict=False)]


def _mark(batches, length: int, buckets: int, texts: bool):
    """Each pack with its flags. Out come results (0), documents still open (1), surroundings to be sorted (2). Entries
    are numbered through the blocks of the pack."""
    for (pack,), rows in _runs(batches, 1):
        flags = {bucket: np.frombuffer(loosened(data), np.uint8) for tag, bucket, data in rows if tag == 0}
        blocks = sorted((place, data) for tag, place, data in rows if tag == 1)
        del rows
        passed = dict.fromkeys(flags, 0)
        before, sent, waiting = 0, [], 0
        for _, data in blocks:
            b = Block(*pickle.loads(loosened(data)), length, buckets)
            flag = np.zeros(len(b.first), np.uint8)
            edges = b.edges.tolist()
            for k, s, t in zip(b.buckets.tolist(), edges, edges[1:], strict=False):
                if k in flags:
                    flag[b.order[s:t]] = flags[k][passed[k] : passed[k] + t - s]
                    passed[k] += t - s
            out, own = _mark_block(b, flag, before, length, buckets, texts)
            before += len(b.first)
            yield _step(pack, out)
            del b, flag
            trim()
            if own:
                sent.append(own)
                waiting += sum(map(len, own[-1]))
            if waiting > PACK:
                yield _step(pack, _windows(sent))
                waiting = 0
        if sent:
            yield _step(pack, _windows(sent))


def _mark_block(b: Block, flag: np.ndarray, before: int, length: int, buckets: int, texts: bool) -> tuple[list, tuple]:
    own, of_doc = flag[b.entry], b.ids[b.doc]
    full = (own == 1) | (of_doc > b.smallest[b.entry])
    part = (own >= 2) & (of_doc == b.smallest[b.entry])
    cover = _cover(len(b.data), b.lo[full], b.hi[full], length)
    pending = np.zeros(len(b.ids), bool)
    pending[b.doc[part]] = True
    out, sent = [(0, -1, squeezed(_digest(b.ids, b.bounds, b.data, cover, np.flatnonzero(~pending).tolist(), texts)))], ()
    if pending.any():
        open_ = np.flatnonzero(pending).tolist()
        shift = np.zeros(len(b.ids), np.int64)
        sizes = np.array([b.bounds[i + 1] - b.bounds[i] for i in open_])
        new = np.concatenate([[0], np.cumsum(sizes)])
        for k, i in enumerate(open_):
            shift[i] = new[k] - b.bounds[i]
        pieces = [slice(b.bounds[i], b.bounds[i + 1]) for i in open_]
        text, done = np.concatenate([b.data[s] for s in pieces]), np.concatenate([cover[s] for s in pieces])
        lo, entry = b.lo[part] + shift[b.doc[part]], b.entry[part]
        out.append((1, -1, squeezed((b.ids[open_], new, text.tobytes(), np.packbits(done).tobytes(), lo, b.hi[part] - b.lo[part] + 1, entry + before))))
        entries = np.flatnonzero(flag >= 2)
        run = b.first[entries]
        lo, size = b.lo[run], b.hi[run] - b.lo[run] + 1
        hot = flag[entries] == 3
        e, win = entries[~hot], np.zeros(int((~hot).sum()), np.int64)
        at, many, docs = lo[~hot], size[~hot], b.smallest[e]
        where = np.zeros(len(e), np.int64)
        key = b.gram[e]
        where[:] = key.astype(np.int64) % buckets
        if hot.any():  # window by window, each in the bucket of its own bytes; equal ones of this block once
            w_e = np.repeat(entries[hot], size[hot])
            w_win = np.concatenate([np.arange(n) for n in size[hot].tolist()])
            w_at = np.repeat(lo[hot], size[hot]) + w_win
            bytes_of = [b.data[i : i + length].tobytes() for i in w_at.tolist()]
            hashes = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") >> 1 for x in bytes_of], np.int64)
            same = np.unique(np.frombuffer(b"".join(bytes_of), f"V{length}"), return_inverse=True)[1].ravel()  # equal bytes, not only hashes
            order = np.lexsort((b.smallest[w_e], same))
            lead = starts_of(same[order])
            first = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
            later = b.smallest[w_e[order]] > b.smallest[w_e[first]]
            gone = order[later]
            if len(gone):
                out.append((3, -1, squeezed((w_e[gone] + before, w_win[gone]))))
            pick = order[~later]
            e, win, at = np.append(e, w_e[pick]), np.append(win, w_win[pick]), np.append(at, w_at[pick])
            many, docs, where = np.append(many, np.ones(len(pick), np.int64)), np.append(docs, b.smallest[w_e[pick]]), np.append(where, hashes[pick] % buckets)
            key = np.append(key, (hashes[pick] >> 31).astype(np.uint32))
        if len(e):
            windows = [b.data[i : i + m + length - 1].tobytes() for i, m in zip(at.tolist(), many.tolist(), strict=True)]
            sent = ((e + before).astype(np.uint32), win.astype(np.uint32), many.astype(np.uint32), docs, key, where, windows)
    return out, sent


def _sort_suffixes(batches, length: int):
    """One bucket of window suffixes at a time: those whose bytes an earlier document has too, by pack. Equal windows have
    equal keys (of the anchor, or of their bytes), so a bucket is sorted in slices of whole keys."""
    for _, rows in _runs(batches, 1):
        parts = [pickle.loads(loosened(data)) for _, data in rows]
        packs = [pack for pack, _ in rows]
        del rows
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        entry, win, many, docs, key = (np.concatenate([p[k] for p in parts]) for k in range(5))
        text = np.concatenate([*(np.frombuffer(p[5], np.uint8) for p in parts), np.zeros(length + 16, np.uint8)])
        del parts
        many = many.astype(np.int64)
        begin = np.cumsum(many + length - 1) - (many + length - 1)
        by = np.argsort(key, kind="stable")
        hits = []
        for s, t in slices_of(key[by], many[by], SLICE):
            own = by[s:t]
            n = many[own]
            item = np.repeat(own, n)
            inner = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            order, group = sort_bucket(text, begin[item] + inner, length)
            item, inner = item[order], inner[order]
            d = docs[item]
            new = starts_of(group)
            hit = d > np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
            item, inner = item[hit], inner[hit]
            hits.append((source[item], entry[item], win[item] + inner.astype(np.uint32)))
        source, entry, win = (np.concatenate(c) for c in zip(*hits, strict=True))
        order = np.argsort(source, kind="stable")
        source, entry, win = source[order], entry[order], win[order]
        edges = [*np.flatnonzero(starts_of(source)).tolist(), len(source)]
        for s, t in zip(edges, edges[1:], strict=False):
            yield pa.RecordBatch.from_arrays([pa.array([packs[source[s]]]), pa.array([squeezed((entry[s:t], win[s:t]))], pa.binary())], ["pack", "data"])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("whole", pa.string())])


def _loads(data: bytes):
    return pickle.loads(loosened(data))


def _finish(batches, length: int, texts: bool):
    """The documents that were open, with the windows found for them."""
    for _, rows in _runs(batches, 1):
        got = [_loads(data) for tag, data in rows if tag == 0]
        if got:
            e, w = np.concatenate([g[0] for g in got]).astype(np.int64), np.concatenate([g[1] for g in got]).astype(np.int64)
            order = np.argsort(e, kind="stable")
            e, w = e[order], w[order]
        for data in (data for tag, data in rows if tag == 1):
            ids, bounds, text, done, lo, size, entry = _loads(data)
            data = np.frombuffer(text, np.uint8)
            cover = np.unpackbits(np.frombuffer(done, np.uint8), count=len(data)).astype(bool)
            if got:
                a, z = np.searchsorted(e, entry), np.searchsorted(e, entry, side="right")
                n = z - a
                at = np.repeat(lo, n) + w[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                cover |= _cover(len(data), at, at, length)
            yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(_digest(ids, bounds, data, cover, range(len(ids)), texts), _OUT, strict=True)], schema=_OUT).to_batches()


def _results(batches):
    for batch in batches:
        for data in batch.column(0):
            yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(_loads(data.as_buffer().to_pybytes()), _OUT, strict=True)], schema=_OUT).to_batches()


def _flags(blocks: DataFrame, length: int, buckets: int) -> DataFrame:
    entries = blocks.select("pack", "data").mapInArrow(partial(_entries, length=length, buckets=buckets), "bucket int, pack string, data binary")
    return cut(entries.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "pack string, bucket int, data binary"))


def _marked(blocks: DataFrame, flags: DataFrame, length: int, buckets: int, texts: bool) -> DataFrame:
    both = flags.select("pack", F.lit(0).alias("tag"), "bucket", "data").unionByName(blocks.select("pack", F.lit(1).alias("tag"), F.col("place").alias("bucket"), "data"))
    return cut(both.repartition("pack").sortWithinPartitions("pack").mapInArrow(partial(_mark, length=length, buckets=buckets, texts=texts), "kind int, pack string, bucket int, data binary"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, whole: documents without bytes covered by strings of
    `length` bytes that also start in a document with a smaller doc_id. kept, the text that remains, where a character
    whose bytes are removed in part stays whole, and whole, the MD5 of the text as it was, are given if `texts` and
    something is removed, and else null.

    Matches never cross documents and are judged on the input. Null texts are empty. Rows with one doc_id are one
    document's and do not match each other; a row without doc_id is returned as it is and removes nothing. Texts
    shorter than `length` are returned whole. Other columns are ignored.

    Texts are cut into compressed blocks in the checkpoint folder. Within a block equal strings are folded before
    anything is shuffled, so a passage in every document costs each bucket one entry a block.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    named = rows.where("doc_id is not null")
    blocks = cut(named.mapInArrow(_pack_blocks, "pack string, place int, bytes bigint, data binary"))
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    buckets = buckets_for(size)
    flags = _flags(blocks, length, buckets)
    marked = _marked(blocks, flags, length, buckets, texts)
    discard(blocks)
    discard(flags)
    suffixes = marked.where("kind = 2").select("bucket", "pack", "data").repartition("bucket").sortWithinPartitions("bucket")
    found = suffixes.mapInArrow(partial(_sort_suffixes, length=length), "pack string, data binary").select("pack", F.lit(0).alias("tag"), "data")
    local = marked.where("kind = 3").select("pack", F.lit(0).alias("tag"), "data")
    rest = found.unionByName(local).unionByName(marked.where("kind = 1").select("pack", F.lit(1).alias("tag"), "data"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string, whole string"
    late = rest.repartition("pack").sortWithinPartitions("pack").mapInArrow(partial(_finish, length=length, texts=texts), schema)
    early = marked.where("kind = 0").select("data").mapInArrow(_results, schema)
    odd = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.lit(None).cast("string").alias("kept"), F.lit(None).cast("string").alias("whole"))
    return early.unionByName(late).unionByName(odd)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated strings cut out of `text` as remove_repeats says, n_chars (if there) counted anew, and all other
    columns as they are. Rows that lose nothing, or have no doc_id, stay the same; so does the order of columns."""
    changed = remove_repeats(docs, length, texts=True).where("kept is not null").select(F.struct(F.col("doc_id").alias("id"), F.col("whole").alias("md5")).alias("key"), "kept")
    changed = cut(changed).dropDuplicates(["key"])
    held = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col("doc_id").cast("bigint").alias("id"), F.md5(F.col("text").cast("string")).alias("md5")).alias("key"))  # no name of docs can clash
    found = held.join(changed, "key", "left")
    values = {"text": F.coalesce("kept", "row.text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(values.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
