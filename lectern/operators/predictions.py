"""Prediction tables: scoring, accuracy, macro-F1, recall and confusion, across sets and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(logits: Column, digits: int = 4) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(logits, lambda x: F.round(F.exp(x - top) / total, digits))


def argmax(values: Column, names: list[str], place: int = 0) -> Column:
    """The name of the largest value (place 1: the runner-up); of equal ones the first."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))
    return F.element_at(F.array(*map(F.lit, names)), F.array_sort(pairs)[place]["i"] + 1)


def confusion_counts(rows: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    return rows.groupBy(*by, truth, pred).agg(F.count("*").alias("n"))


def metrics(rows: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """accuracy, macro_f1 and recall_<class> per group; a class without rows counts 0. One count by (truth, pred), then sums."""
    cells = confusion_counts(rows, by)
    over = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = [over(F.col("truth") == F.col("pred")).alias("_right"), F.sum("n").alias("_n")]
    for c in classes:
        own, said = F.col("truth") == c, F.col("pred") == c
        sums += [over(own & said).alias(f"_tp_{c}"), over(own).alias(f"_t_{c}"), over(said).alias(f"_p_{c}")]
    got = cells.groupBy(*by).agg(*sums)
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = [part(2 * F.col(f"_tp_{c}"), F.col(f"_t_{c}") + F.col(f"_p_{c}")) for c in classes]
    return got.select(
        *by,
        F.round(F.col("_right") / F.col("_n"), 6).alias("accuracy"),
        F.round(sum(f1, F.lit(0.0)) / len(classes), 6).alias("macro_f1"),
        *[F.round(part(F.col(f"_tp_{c}"), F.col(f"_t_{c}")), 6).alias(f"recall_{c}") for c in classes],
    )


def epoch(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"_e(\d+)", 1), F.lit("")).cast("int")


def flattened(rows: DataFrame, by: str, column: str, sets: list[str], values: list[str]) -> DataFrame:
    """One row per `by` with <set>_<value> columns."""
    wide = rows.groupBy(by).pivot(column, sets).agg(*[F.first(v).alias(v) for v in values])
    return wide


def confusion(rows: DataFrame, classes: list[str]) -> DataFrame:
    """truth, one column per predicted class, n, correct and recall."""
    wide = rows.groupBy("truth").pivot("pred", classes).count().na.fill(0, classes)
    right = F.coalesce(*[F.when(F.col("truth") == c, F.col(c)) for c in classes], F.lit(0))
    n = sum((F.col(c) for c in classes), F.lit(0))
    return wide.select("*", n.alias("n"), right.alias("correct"), F.round(right / n, 6).alias("recall"))


def largest_gap(rows: DataFrame, by: str, score: str) -> DataFrame:
    """Per class the largest gap between neighbouring scores, where it starts (the lowest of equal ones), and how many lie strictly within 0.3 and 0.7.

    Distinct scores are counted and dealt into ranges by sampled bounds; neighbours are looked for inside each range,
    and then between the highest score of a range and the lowest of the next. So a class of many scores is the work of many tasks.
    """
    values = rows.groupBy(F.col(by).alias(by), F.col(score).alias("_score")).agg(F.count("*").alias("_n"))
    ranges = values.repartitionByRange(by, "_score").withColumn("_range", F.spark_partition_id())
    previous = F.lag("_score").over(Window.partitionBy(by, "_range").orderBy("_score"))
    near = ranges.withColumn("_below", previous).withColumn("_gap", F.round(F.col("_score") - F.col("_below"), 6))
    first = lambda gap, below: F.max_by(F.col(below), F.struct(F.col(gap), -F.col(below)))
    inside = F.sum(F.when((F.col("_score") > 0.3) & (F.col("_score") < 0.7), F.col("_n")).otherwise(0))
    each = near.groupBy(by, "_range").agg(F.max("_gap").alias("_gap"), first("_gap", "_below").alias("_starts"), F.min("_score").alias("_low"), F.max("_score").alias("_high"), inside.alias("_unsure"))
    border = F.lag("_high").over(Window.partitionBy(by).orderBy("_low"))  # a row for each range
    met = each.withColumn("_before", border)
    own, between = F.struct(F.col("_gap").alias("gap"), F.col("_starts").alias("below")), F.struct(F.round(F.col("_low") - F.col("_before"), 6).alias("gap"), F.col("_before").alias("below"))
    told = met.select(by, "_unsure", F.explode(F.array(own, between)).alias("_g"))
    parts = told.groupBy(by).agg(F.max("_g.gap").alias("gap"), F.max_by("_g.below", F.struct("_g.gap", -F.col("_g.below"))).alias("starts"), (F.sum("_unsure") / 2).cast("bigint").alias("unsure"))
    return parts.select(by, "gap", "starts", "unsure")


def misses(rows: DataFrame, score: str) -> DataFrame:
    return rows.filter("truth <> pred").orderBy(F.desc(score), "name")
