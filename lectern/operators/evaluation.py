"""Retrieval metrics and their reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.sizes import small

EVIDENCE_SHARE = 0.5
LEVELS = ("article", "evidence", "answer")


def is_evidence(passage: Column, evidence: Column) -> Column:
    return tx.overlap(tx.shingles(passage), tx.shingles(evidence)) >= EVIDENCE_SHARE


def metrics(hits: DataFrame, k: int, by: list[str], relevant: str = "relevant") -> DataFrame:
    """hit_at_1, hit_at_k, mrr and ndcg_at_k of hits with rank and a 0/1 column; the ideal order is of what was retrieved."""
    top = hits.filter(F.col("rank") <= k)
    yes = F.col(relevant) == 1
    summed = top.groupBy(*by).agg(
        F.max(F.when(yes & (F.col("rank") == 1), 1.0).otherwise(0.0)).alias("hit_at_1"),
        F.max(F.when(yes, 1.0).otherwise(0.0)).alias("hit_at_k"),
        F.coalesce(F.max(F.when(yes, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(yes, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(yes, 1).otherwise(0)).cast("int").alias("_n"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("_n", F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return summed.withColumn("ndcg_at_k", F.when(F.col("_n") > 0, F.round(F.col("_dcg") / ideal, 6)).otherwise(0.0)).drop("_dcg", "_n")


def flags(hits: DataFrame, questions: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Adds article and evidence flags, and answer where a question has gold passages (doc_id, text), else null."""
    q = questions.select("question_id", F.col("source_doc_id"), F.col("evidence"))
    joined = hits.join(q, "question_id")
    article = F.coalesce(F.col("doc_id") == F.col("source_doc_id"), F.lit(False))
    out = joined.withColumn("article", article.cast("int")).withColumn("evidence_flag", F.when(article, is_evidence(F.col("text"), F.col("evidence")).cast("int")).otherwise(0))
    out = out.drop("evidence", "source_doc_id").withColumnRenamed("evidence_flag", "evidence")
    if gold is None:
        return out.withColumn("answer", F.lit(None).cast("int"))
    having = gold.select("question_id").distinct().withColumn("_has", F.lit(1))
    mark = gold.select("question_id", "doc_id", "text").distinct().withColumn("_gold", F.lit(1))
    out = out.join(having, "question_id", "left").join(mark, ["question_id", "doc_id", "text"], "left")
    return out.withColumn("answer", F.when(F.col("_has") == 1, F.coalesce("_gold", F.lit(0)))).drop("_has", "_gold")


def scores(flagged: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """question_id, level and metrics; a question without hits scores 0, one without gold has no answer level."""
    long = flagged.unpivot(["question_id", "rank"], list(LEVELS), "level", "relevant").filter("relevant is not null")
    got = metrics(long, k, ["question_id", "level"])
    every = questions.select("question_id").crossJoin(F.broadcast(questions.sparkSession.createDataFrame([(level,) for level in LEVELS[:2]], "level string")))
    base = every.unionByName(got.filter("level = 'answer'").select("question_id", "level"))
    return base.join(got, ["question_id", "level"], "left").na.fill(0.0)


def configuration_means(rows: DataFrame, keys: list[str], values: list[str], by: list[str]) -> DataFrame:
    """Means of `values` for each configuration, overall and by each column of `by` alone."""
    sets = [keys, *([*keys, b] for b in by)]
    cube = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, *by]])
    return cube.agg(*[F.round(F.avg(c), 6).alias(c) for c in values], F.count("*").alias("n"))


def paired_difference(pairs: DataFrame, by: list[str], draws: int = 2000, seed: int = 0) -> DataFrame:
    """diff, ci_low, ci_high, gained, lost of `after` - `before` per group: a 95 % bootstrap over one number per question.

    Equal differences are counted first. A task then weighs each difference by Poisson(its count) in every draw, with
    a generator of the difference's own, and adds up a weight and a sum for each draw; Spark adds these over the
    tasks. So no group is one task's, and neither the order nor the partitions of the rows change the result. Rows with a null
    on either side are left out, and so is a group of such rows alone.
    """
    d = (F.col("after") - F.col("before")).cast("double")
    counted = pairs.select(*by, d.alias("d")).filter("d is not null").groupBy(*by, "d").agg(F.count("*").alias("n"))
    own = F.xxhash64(F.lit(seed), *by, "d")
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            arrays = [pa.array(list(c)) for c in zip(*held, strict=True)] if by else []
            listed = [pa.array([x[k].tolist() for x in held.values()], pa.list_(pa.float64())) for k in range(2)]
            return pa.RecordBatch.from_arrays([*(a.cast(schema.field(c).type) for a, c in zip(arrays, by, strict=True)), *listed], names=[*by, "weights", "sums"])

        for batch in batches:
            schema = batch.schema
            for *key, value, n, spot in zip(*(batch[c].to_pylist() for c in (*by, "d", "n", "spot")), strict=True):
                weights = np.random.default_rng(spot & (1 << 63) - 1).poisson(n, draws).astype(float)
                sums = held.setdefault(tuple(key), np.zeros((2, draws)))
                sums += np.stack([weights, weights * value])
                if len(held) > 1_000:
                    yield told()
                    held.clear()
        if held:
            yield told()

    parts = counted.withColumn("spot", own).select(*by, "d", "n", "spot").mapInArrow(weigh, ", ".join(filter(None, [kinds, "weights array<double>, sums array<double>"])))
    each = parts.select(*by, F.posexplode(F.arrays_zip("weights", "sums")).alias("draw", "s"))
    drawn = each.groupBy(*by, "draw").agg(F.sum("s.weights").alias("w"), F.sum("s.sums").alias("s")).filter("w > 0")
    means = drawn.groupBy(*by).agg(F.array_sort(F.collect_list(F.col("s") / F.col("w"))).alias("means"))  # as many as draws
    place = lambda share: F.greatest(F.lit(1), F.ceil(share * F.size("means"))).cast("int")
    ends = means.select(*by, F.element_at("means", place(0.025)).alias("ci_low"), F.element_at("means", place(0.975)).alias("ci_high"))
    over = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    known = counted.groupBy(*by).agg((F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("diff"), over(F.col("d") > 0).alias("gained"), over(F.col("d") < 0).alias("lost"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by] or [F.lit(True)]
    return known.alias("k").join(small(ends).alias("e"), same).select(*[f"k.{c}" for c in by], "diff", "ci_low", "ci_high", "gained", "lost")
