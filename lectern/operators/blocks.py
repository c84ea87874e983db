"""A stated set of queries against all rows of a table, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of queries that are sent to every executor; more meet the rows block by block.
SENT_BYTES = 8 << 20
#: Queries of a block and rows of a part beyond that, and rows that are worked off at once.
QUERY_BLOCK, PART_ROWS, WORK_ROWS = 4_000, 20_000, 2_048


def matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def best_rows(found: pa.Table, k: int, by: list[str], score: str, item: str) -> pa.Table:
    """The k rows of the highest score for each `by`, of equal ones those with the smaller item."""
    keys = [found[c].to_numpy() for c in by]
    order = np.lexsort([found[item].to_numpy(), -found[score].to_numpy(), *keys])
    if not len(order):
        return found
    new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0))
    place = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return found.take(order[place < k])


def against_all(
    rows: DataFrame,
    row_key: str,
    asked: DataFrame,
    asked_key: str,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    shrink: Callable[[pa.Table], pa.Table],
    schema: str,
    vector: str = "asked",
    sent_bytes: int = SENT_BYTES,
    block: int = QUERY_BLOCK,
    part: int = PART_ROWS,
) -> DataFrame:
    """What `work` finds for (some rows, some queries) over all pairs of both; `shrink` leaves what can still count of several findings.

    Queries of at most `sent_bytes`, counted with their vectors, are sent to every executor and the rows are
    only read: a task keeps what `shrink` leaves of all it has read. More queries are dealt into blocks of about
    `block` and the rows into parts of about `part`, and every block meets every part in one group of
    bounded size. Either way the findings are those of all pairs.
    """
    spark = rows.sparkSession
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size(vector) * 8 + 64), F.lit(0))).first()

    def small_parts(held: pa.Table, wanted: pa.Table) -> Iterator[pa.Table]:
        for start in range(0, held.num_rows, WORK_ROWS):
            yield work(held.slice(start, WORK_ROWS), wanted)

    if size <= sent_bytes:
        sent = spark.sparkContext.broadcast(asked.toArrow())

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, fresh = [], 0
            for batch in batches:
                for found in small_parts(pa.Table.from_batches([batch]), sent.value) if sent.value.num_rows else ():
                    kept.append(found)
                    fresh += found.num_rows
                if fresh > 500_000:
                    kept, fresh = [shrink(pa.concat_tables(kept))], 0
            if kept:
                yield from shrink(pa.concat_tables(kept)).combine_chunks().to_batches()

        return rows.mapInArrow(read, schema)

    n_blocks, n_parts = -(-n // block), max(spark.sparkContext.defaultParallelism, -(-rows.count() // part))
    dealt = lambda column, count: F.pmod(F.xxhash64(column), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    parts = rows.withColumn("_part", dealt(row_key, n_parts)).withColumn("_block", every(n_blocks))
    blocks = asked.withColumn("_block", dealt(asked_key, n_blocks)).withColumn("_part", every(n_parts))

    def meet(held: pa.Table, wanted: pa.Table) -> pa.Table:
        found = list(small_parts(held, wanted)) if held.num_rows and wanted.num_rows else []
        return shrink(pa.concat_tables(found)) if found else work(held.slice(0, 0), wanted.slice(0, 0))

    return parts.groupBy("_part", "_block").cogroup(blocks.groupBy("_part", "_block")).applyInArrow(meet, schema)
