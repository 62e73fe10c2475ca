"""What the training-data operators share: reading, checkpoints, Arrow streaming."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators.shared import cut, delete, discard, shared_folder  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def trim() -> None:
    """Freed memory goes back to the system: a Python worker serves many tasks and would keep the most that one of them took."""
    pa.default_memory_pool().release_unused()
    of_libc = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if of_libc:
        of_libc(0)


def rows_by_bytes(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20, rows: int = 2500) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most `rows` rows whose texts hold about `most` bytes, one row at least. Memory is
    trimmed after the last."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start, held = 0, 0
        lengths = pa.compute.binary_length(column).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and (held + (n or 0) > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)
    trim()


def mapped(df: DataFrame, function: Callable, schema: str, **kept) -> DataFrame:
    """function(slice as pyarrow.RecordBatch, **kept) -> pyarrow.Table or dict of lists, over slices of bounded bytes."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    bytes_column = "text"

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for part in rows_by_bytes(batches, bytes_column):
            got = function(part, **kept)
            if got is None:
                continue
            yield from pa.Table.from_pydict(got, schema=arrow).to_batches()

    return df.mapInArrow(run, schema)
