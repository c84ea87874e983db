"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable


def _hung(edges: DataFrame) -> DataFrame:
    """Each edge with the least neighbour of its `node`: node, other, least."""
    least = edges.groupBy("node").agg(F.min("other").alias("least"))
    return edges.join(least, "node")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b) but the roots; root is the smallest node it can reach.

    Every round hangs larger neighbours on a node's least neighbour (large star), then smaller ones on the
    least of them (small star), until nothing changes: a number of rounds that grows with the logarithm of
    the longest chain. Minima are pre-aggregated and joined back, so a hub is never one task's group; each
    round is checkpointed. Null, repeated and self links are left out; no links give an empty result.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct()
    edges = durable(edges)
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.withColumnRenamed("other", "root")
        seen = mark
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _hung(both).filter("other > node").select(F.col("other").alias("node"), F.least("node", "least").alias("other"))
        small = _hung(large.distinct())
        # A row hangs its `other` on the least one, and its node too.
        hung = small.select(F.explode(F.array(F.struct(F.col("other").alias("node"), F.col("least").alias("other")), F.struct("node", F.col("least").alias("other")))).alias("e")).select("e.*")
        edges = durable(hung.filter("node <> other").distinct())
