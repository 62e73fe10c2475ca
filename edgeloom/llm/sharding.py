"""Hilbert-curve sharding: rows ordered along a Hilbert curve through several quantised dimensions, cut into runs.

Runs of a space-filling curve are compact in every dimension, so each shard covers a small range of each and a reader
can skip shards by any of them.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.llm.common import cut, discard, text_of

SHARDS = 24
BITS = 6
OVERHEAD = 8
#: share of a shard up to which equal texts are kept together
WHOLE = 0.05


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of unsigned coordinates below 2^bits (Skilling's transposition)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            hit = (x[i] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> b & 1
    return out


def quantised(dimensions: list[Column], bits: int = BITS) -> Column:
    """The Hilbert index of integer columns, each clipped to 0 .. 2^bits - 1; null counts as 0."""
    top = (1 << bits) - 1

    @F.pandas_udf("bigint")
    def index(frame):
        import pandas as pd

        return pd.Series(hilbert(frame.to_numpy(np.int64), bits))

    cells = [F.greatest(F.lit(0), F.least(F.lit(top), F.coalesce(c.cast("int"), F.lit(0)))).alias(f"d{i}") for i, c in enumerate(dimensions)]
    return index(F.struct(*cells))


def _local(batches, size: int):
    part, n, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = total + np.cumsum(sizes)
        m = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(m, part, np.int32)), pa.array(n + np.arange(m, dtype=np.int64)), pa.array(ends - sizes)],
            [*batch.schema.names, "part", "nth", "before"],
        )
        n, total = n + m, int(ends[-1]) if m else total


def placed(rows: DataFrame, order: list[str], size: str = "size") -> DataFrame:
    """rows in the total order of `order`, with their global rank and the sizes before them, in the checkpoint folder.

    Range partitions are numbered and summed one by one; the totals of the partitions (one row each) give the offsets.
    """
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = rows.schema.simpleString()[len("struct<") : -1]
    local = cut(rows.mapInArrow(partial(_local, size=rows.columns.index(size)), f"{schema},part:int,nth:bigint,before:bigint"))
    totals = local.groupBy("part").agg(F.count("*").alias("n"), F.sum(size).alias("s"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(w), F.lit(0)).alias("s0"))
    joined = local.join(F.broadcast(offsets), "part")  # a row for each partition of the sort
    return joined.withColumn("rank", F.col("n0") + F.col("nth")).withColumn("before", F.col("s0") + F.col("before")).drop("part", "nth", "n0", "s0")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents cut into `shards` runs of the Hilbert order, of near equal bytes: the rows of op10.

    Dimensions: language and source (hashed to 6 bits) and the logarithm of the size, taken for a group of equal texts
    as a whole (the smallest language and source in it), so that equal texts are neighbours; order within a cell is by
    text digest and doc_id. A group of equal texts stays in one shard (the one that holds its middle) up to WHOLE of a
    shard's bytes, or the size of the largest document if that is more; what is larger is cut where the bytes say, as
    otherwise shards could not be near equal.

    Null texts have size 8 and make one group with empty texts; null languages and sources count as empty, a null
    doc_id comes first in its group; repeated rows take slots of their own; an empty table gives no rows; other
    columns are ignored.
    """
    text = text_of()
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + F.lit(OVERHEAD)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in ("lang", "source")),
    )
    rows = cut(rows)
    key = ["h1", "h2", "size"]
    groups = rows.groupBy(*key).agg(F.min("lang").alias("lang"), F.min("source").alias("source"), F.count("*").alias("copies"))
    cells = [F.pmod(F.xxhash64("lang"), F.lit(1 << BITS)), F.pmod(F.xxhash64("source"), F.lit(1 << BITS)), F.floor(F.log2(F.col("size")) * 2)]
    groups = groups.select(*key, "copies", quantised(cells).alias("cell"))
    keyed = rows.select("doc_id", "text_crc32", *key).join(groups, key).select("cell", *key, "doc_id", "text_crc32", "copies")
    sorted_rows = placed(keyed, ["cell", *key, "doc_id", "text_crc32"])
    ordered = cut(sorted_rows)
    discard(rows)
    whole = ordered.agg(F.sum("size").alias("all"), F.max("size").alias("largest")).first()
    target = max(1.0, (whole["all"] or 0) / shards)
    small = F.col("copies") * F.col("size") <= F.lit(max(WHOLE * target, whole["largest"] or 0))
    starts = ordered.where(small & (F.col("copies") > 1)).groupBy(*key).agg(F.min("before").alias("start"))
    middle = F.coalesce(F.col("start") + F.col("copies") * F.col("size") / 2, F.col("before") + F.col("size") / 2)
    cutting = ordered.join(starts, key, "left").withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / F.lit(target))).cast("int"))
    first = cutting.groupBy("shard").agg(F.min("rank").alias("first"))
    return cutting.join(F.broadcast(first), "shard").select(  # `shards` rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
