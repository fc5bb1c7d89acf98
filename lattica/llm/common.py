"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.shared import new_path, shared_dir, shuffle_width, stash

__all__ = ["SLICE", "held_out", "list_array", "new_path", "shared_dir", "shuffle_width", "slices", "small_batches", "stash", "table"]

#: Rows that a Python worker turns into Python objects at a time.
SLICE = 256
#: Bytes of the batches that Spark sends to Python workers: a few long texts fill one.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session was told to bound batches for Python by bytes (unless it has a bound of its own)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def list_array(values, lengths, kind: pa.DataType) -> pa.ListArray:
    """A list column from all values, one after another, and each row's length."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def held_out(doc_id, divisor: int, remainder: int = 2):
    """Whether the crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor == remainder
