"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lectern.operators.durable import durable
from lectern.operators.sizes import spread

__all__ = ["BATCH_BYTES", "SLICE_ROWS", "durable", "sized", "slices", "small_batches", "table"]

#: Rows that a Python task turns into Python objects at once; bounds its memory, never what it reads.
SLICE_ROWS = 256
#: Bytes of the Arrow batches that Spark fills for a Python task under `small_batches`.
BATCH_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of at most `rows` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sized(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of which the texts or bytes in a column are at most so many bytes, or of one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy().astype(np.int64).cumsum()
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(size, done + most, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(size[stop - 1])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends Python tasks batches of about BATCH_BYTES, or of one row; the session's setting is put back after.

    Spark's own bound is 64 MB: its buffers double as they grow, and the worker holds a batch while it reads the next one.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows
