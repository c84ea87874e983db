"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the small side of a join that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, counted without reading further than that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hinted(df: DataFrame, most: int, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same where a bound on df's rows is known already, so that df is not computed to be counted."""
    return F.broadcast(df) if most <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer.

    A Parquet file is read by as many tasks as it has row groups at most, so a small table of one row group would
    be one core's work. Tables of many files are left as they are, and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
