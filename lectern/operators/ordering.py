"""Seeded orders that do not depend on partitioning, and exact places in them without one big window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.durable import durable
from lectern.operators.sizes import small

#: Hexadecimal digits of the hash by which an order is cut into ranges.
DIGITS = 3


def hash_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def ranked(rows: DataFrame, key: str, seed: int, by: list[str] | None = None) -> DataFrame:
    """Adds rank, from 1, in seeded order over all rows, or over those of each `by`.

    The order is cut into ranges of the hash; each range is ranked by itself and starts after the counted
    rows of the ranges before it, so no task holds more than a range, however few the groups.
    """
    by = by or []
    cut = rows.withColumn("_spot", hash_order(seed, key)).withColumn("_range", F.substring("_spot", 1, DIGITS))
    sizes = cut.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(1)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    # Without groups there are at most 16 ** DIGITS ranges.
    starts = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_spot", key))
    return cut.withColumn("_inside", inside).join(small(starts) if by else F.broadcast(starts), [*by, "_range"]).withColumn("rank", F.col("_before") + F.col("_inside")).drop("_spot", "_range", "_inside", "_before")


def in_ranges(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows with _range, the number of the range of (by, order) that they are in: a long group is cut into ranges of bounded size. Written once, as bounds are sampled anew each time."""
    return durable(rows.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id()))


def running(ranged: DataFrame, by: str, order: str, values: dict[str, Column], merge=F.sum) -> DataFrame:
    """Adds, for each name, the sum (or other merge) of a value over the rows of a group up to each row, without one task for a group.

    ranged is a result of `in_ranges`. Each range is worked off by itself, and what the ranges before it come to is
    added: only groups that reach over several ranges have such a row, so there are fewer than ranges.
    """
    inside = Window.partitionBy(by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy(by, "_range").agg(*[merge(v).alias(f"_{n}") for n, v in values.items()])
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(by, "_range", F.count("*").over(before).alias("_earlier"), *[merge(f"_{n}").over(before).alias(f"_{n}") for n in values]).filter("_earlier > 0").drop("_earlier")
    with_own = ranged.withColumns({n: merge(v).over(inside) for n, v in values.items()})
    joined = with_own.join(small(carried), [by, "_range"], "left")
    pair = lambda n: F.array_compact(F.array(F.col(f"_{n}"), F.col(n)))
    both = (lambda n: F.coalesce(f"_{n}", F.lit(0)) + F.coalesce(n, F.lit(0))) if merge is F.sum else (lambda n: F.array_max(pair(n)))
    return joined.withColumns({n: both(n) for n in values}).drop(*[f"_{n}" for n in values])
