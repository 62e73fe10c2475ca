"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification, connected components.

Two permutations of 2^32 positions make all signature coordinates: the first spreads the shingles, the second is
applied to their positions shifted circularly by 0, 1, 2, ... Candidates are verified on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.bytewords import _LOWER, hash_words, mix64, shingles
from edgeloom.llm.common import cut, mapped, text_of, trim

ROWS, BANDS = 5, 32
#: of the bitmap in which each shingle flips one bit: two bitmaps never differ in more bits than the sets in shingles
BITS = 1024
#: members of a bucket that one task compares with as many others
BLOCK = 1024
#: documents that one task compares with one other at a time
CHUNK = 64
#: edges for which components are written to one file
EDGES = 20_000
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def signature(hashes: np.ndarray, k: int = ROWS * BANDS) -> np.ndarray:
    """k MinHash coordinates (uint32) of a set of 64-bit hashes."""
    spread = (mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)  # first permutation
    shift = np.arange(k, dtype=np.uint32)[:, None]
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(spread), 512):
        y = (spread[at : at + 512] + shift) * _A  # second permutation, of shifted positions
        y ^= y >> np.uint32(15)
        y *= _B
        y ^= y >> np.uint32(13)
        y *= _C
        np.minimum(out, y.min(axis=1), out=out)
    return out


def bands_of(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    n, k = signatures.shape
    parts = signatures.reshape(n, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64), (n, k // rows)).copy()
    for j in range(rows):
        key = mix64(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, j])
    return key.view(np.int64)


def _words(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER.tobytes()).split()


def shingle_set(raw: bytes, width: int) -> set[bytes]:
    words = _words(raw)
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _sign(part: pa.RecordBatch, width: int) -> dict:
    texts = [v.as_buffer().to_pybytes() for v in part.column(1)]
    hashes, _, bounds, _ = hash_words(texts)
    n, keys, signed, bits = [], [], [], []
    for i, raw in enumerate(texts):
        own = shingles(hashes[bounds[i] : bounds[i + 1]], width)
        n.append(len(own))
        keys.append(hashlib.md5(b" ".join(_words(raw))).digest() if len(own) else None)
        bits.append(np.packbits(np.bincount((own >> np.uint64(54)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes())
        signed.append(signature(own) if len(own) else np.zeros(ROWS * BANDS, np.uint32))
    found = bands_of(np.array(signed)) if n else np.zeros((0, BANDS), np.int64)
    return {"doc_id": part.column(0).to_pylist(), "n": n, "key": keys, "bits": bits, "bands": list(found)}


def _to_roots(step: DataFrame, files: int) -> DataFrame:
    """(id, to) with every pointer followed to its end, which points to itself; pointers double, so depth takes its logarithm."""
    while True:
        further = step.select("to").distinct().join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").where("next <> to")
        further = cut(further, files)
        if further.isEmpty():
            return step
        step = cut(step.join(further, "to", "left").select("id", F.coalesce("next", "to").alias("to")), files)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), for every id that has an edge.

    Each round every vertex points to the smallest in its neighbourhood, pointers are followed to their ends, and the
    edges are contracted to what is left: at most half of the vertices, so rounds are logarithmic for chains as for
    stars. All rows stay in Spark; the driver asks for the number of edges, and whether any edge or pointer is left.
    What the rounds write goes to a file for each EDGES edges, whatever the number of shuffle partitions.
    """
    labels: DataFrame | None = None
    left = cut(edges.select("a", "b").where("a <> b").distinct())
    files = 1 + left.count() // EDGES
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).select(F.col("a").alias("id"), "to"), files)
        step = _to_roots(step, files)
        if labels is None:
            labels = step.select("id", F.col("to").alias("component"))
        else:
            labels = labels.join(step.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = cut(labels, files)
        ends = left.join(step.select(F.col("id").alias("a"), F.col("to").alias("na")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("nb")), "b")
        left = cut(ends.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).where("a <> b").distinct(), files)
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    return labels


def _verify(batches, width: int, percent: int):
    """Rows sorted by (a, chunk, role): first the text of a, then those to compare it with."""
    current, own = None, set()
    for batch in batches:
        a_out, b_out = [], []
        names = batch.schema.names
        cols = [batch.column(names.index(k)) for k in ("a", "chunk", "role", "id")]
        texts = batch.column(names.index("text"))
        for (a, chunk, role, other), text in zip(zip(*(c.to_pylist() for c in cols), strict=True), texts, strict=True):
            if role == 0:
                current, own = (a, chunk), shingle_set(text.as_buffer().to_pybytes(), width)
                continue
            if current != (a, chunk):
                raise ValueError("a candidate pair without its first text")
            s = shingle_set(text.as_buffer().to_pybytes(), width)
            both = len(own & s)
            if s and 100 * both >= percent * (len(own) + len(s) - both):
                a_out.append(a)
                b_out.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])
    trim()


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    The texts are shuffled once by doc_id and sent on only where a pair needs them; the text of a hot `a` is repeated
    once for every CHUNK partners, which then spread over tasks.
    """
    partners = pairs.groupBy("a").agg(F.count("*").alias("m"))
    pairs = pairs.join(partners, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / CHUNK)).cast("int"))
    firsts = pairs.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("role"), F.col("a").alias("id"))
    needs = firsts.unionByName(pairs.select("a", "chunk", F.lit(1).alias("role"), F.col("b").alias("id")))
    rows = needs.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select("a", "chunk", "role", "id", "text")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")
    return rows.mapInArrow(partial(_verify, width=width, percent=percent), "a bigint, b bigint")


def _close_pairs(batches, percent: int):
    """Pairs of different components within each bucket block that their sizes and bitmaps leave possible; rows sorted by block."""
    held: list[tuple] = []
    current = None

    def pairs():
        ids, n, c, side = (np.array([x[k] for x in held], np.int64) for k in range(4))
        bits = np.frombuffer(b"".join(x[4] for x in held), np.uint64).reshape(len(held), BITS // 64)
        own = current[1] == current[2]
        a_out, b_out = [], []
        for k in range(len(held) - 1):
            rest = slice(k + 1, None)
            ok = (c[rest] != c[k]) & (100 * np.minimum(n[k], n[rest]) >= percent * np.maximum(n[k], n[rest]))
            if not own:
                ok &= side[rest] != side[k]
            j = k + 1 + np.flatnonzero(ok)
            if len(j):
                differ = np.bitwise_count(bits[j] ^ bits[k]).sum(1, dtype=np.int64)
                j = j[(100 + percent) * differ <= (100 - percent) * (n[j] + n[k])]
                a_out += np.minimum(ids[j], ids[k]).tolist()
                b_out += np.maximum(ids[j], ids[k]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != current:
                if held:
                    yield pairs()
                held, current = [], row[:3]
            held.append(row[3:])
    if held:
        yield pairs()
    trim()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document: texts with Jaccard of at least percent/100 are linked.

    Words are runs of non-space bytes with A-Z lowered; a set holds the distinct runs of `width` words, or the one run
    of fewer. Null and empty texts have no shingles and are linked with nothing. Copies are folded into a class before
    anything is compared, so a group of copies costs one comparison whatever its size. Repeated rows get equal
    results; other columns are ignored. A row without doc_id is compared under the smallest id of its copies, if any.

    Candidates share one of BANDS band keys of ROWS coordinates: of pairs with similarity 0.8, 3 in a million share
    none. Within a bucket every text is first verified against the smallest id. Only buckets that then still hold
    several components are compared pair by pair, in blocks, and exact bounds (set sizes, and bitmaps that never
    differ in more bits than the sets in shingles) leave few pairs to verify. No bucket is capped.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    signed = cut(mapped(texts, partial(_sign, width=width), "doc_id bigint, n bigint, key binary, bits binary, bands array<bigint>"))
    full = signed.where("n > 0")
    classes = full.groupBy("key").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = reps.select(F.explode("bands").alias("h"), F.col("doc_id").alias("id"), "n")
    shared = rows.groupBy("h").agg(F.min(F.struct("id", "n")).alias("first"), F.count("*").alias("m")).where("m > 1")
    members = cut(rows.join(shared.select("h", F.col("first.id").alias("a"), F.col("first.n").alias("na"), "m"), "h"))
    involved = cut(texts.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    alike = F.expr(f"100 * least(n, na) >= {percent} * greatest(n, na)")
    stars = cut(members.where("a < id").where(alike).select("a", F.col("id").alias("b")).distinct())
    first = cut(verified(stars, involved, width, percent))
    label = components(first)

    labelled = members.join(label, "id", "left").select("h", "id", "n", "m", F.coalesce("component", "id").alias("c"))
    mixed = labelled.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h")
    blocks = labelled.join(mixed, "h").withColumn("k", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    blocks = blocks.join(reps.select(F.col("doc_id").alias("id"), "bits"), "id")
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    blocks = blocks.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", "c", "own", "bits")
    blocks = blocks.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    close = blocks.mapInArrow(partial(_close_pairs, percent=percent), "a bigint, b bigint").distinct()
    close = cut(close.join(stars, ["a", "b"], "left_anti"))
    label = components(first.union(verified(close, involved, width, percent)))

    of_class = classes.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    found = full.join(of_class, "key", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    found = found.union(signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest doc_id stays, one row a doc_id. Rows
    without doc_id, which nothing can name, all stay."""
    kept = cut(near_duplicates(docs, width, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct())
    own = docs["doc_id"].cast("bigint")
    named = docs.join(kept, own == kept["kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(own.isNull()))
