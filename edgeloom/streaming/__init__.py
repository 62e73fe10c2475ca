"""Streaming forms of the upsert and of freshness. The operators they extend are batch; these are additions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgeloom.operators import merge


def upsert_stream(patches: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, fresh: tuple[str, ...] = ("extracted_from",)):
    """Merges each micro-batch of patches into what `read` gives, and hands the whole to `write` with the batch's number.

    The merge is idempotent, so a batch that is repeated after a failure changes nothing.
    """

    def merged(batch: DataFrame, number: int) -> None:
        rows = merge.upsert(read(), batch, fresh=fresh)
        write(rows.drop("outcome").withColumn("seq", F.coalesce("seq", F.row_number().over(W.partitionBy("page").orderBy("target", "type", "endpoint", "condition")) + F.lit((number + 1) << 40))), number)

    return patches.writeStream.foreachBatch(merged).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, key: str, at: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events counted by key and window; what comes later than `late` after the newest is left out of closed windows."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count("*").alias("n"), F.max(at).alias("last_seen"))
