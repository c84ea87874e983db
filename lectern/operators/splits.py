"""Labels, group-level splits without leakage, and class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ordering import ranked

CLASSES = ("CNV", "DME", "DRUSEN", "NORMAL")


def parse_name(name: Column) -> dict[str, Column]:
    """class, patient and slice of a `CLASS-PATIENT-SLICE` file name with or without an extension."""
    parts = F.split(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), "-")
    return {"class": parts[0], "patient": F.get(parts, F.lit(1)), "slice": F.get(parts, F.lit(2))}


def leakage(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Groups of two sets, shared ones, and these as a percentage of the second."""
    left, right = a.select(group).distinct(), b.select(group).distinct()
    both = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), group, "full")
    counted = both.agg(F.count("l").alias("first_groups"), F.count("r").alias("second_groups"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"))
    return counted.withColumn("shared_percent", F.round(100 * F.try_divide(F.col("shared"), F.col("second_groups")), 2))


def group_split(rows: DataFrame, group: str, share: float = 0.1, seed: int = 0, first: str = "val", second: str = "train") -> DataFrame:
    """Adds `split`: int(share * groups) whole groups, in seeded order, are `first`."""
    groups = ranked(rows.select(group).distinct(), group, seed)
    total = groups.agg(F.count("*").alias("_total"))
    labelled = groups.crossJoin(F.broadcast(total)).select(group, F.when(F.col("rank") <= F.floor(share * F.col("_total")), first).otherwise(second).alias("split"))
    return rows.join(labelled, group)


def crosstab(rows: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts per value and TOTAL."""
    wide = rows.groupBy(*by).pivot(column, values).count().na.fill(0, values)
    return wide.withColumn("TOTAL", sum((F.col(v) for v in values), F.lit(0)))


def size_summary(rows: DataFrame, by: str) -> DataFrame:
    span = lambda c: F.format_string("%s-%s", F.min(c), F.max(c))
    ratio = F.round(F.col("w") / F.col("h"), 2)
    return rows.groupBy(by).agg(F.count("*").alias("n"), span("w").alias("widths"), span("h").alias("heights"), F.min(ratio).alias("ratio_low"), F.max(ratio).alias("ratio_high"), F.countDistinct("w", "h").alias("sizes"), F.min_by("path", "path").alias("example"))


def map_label(disease: Column, condition: Column) -> Column:
    """The class of a (disease, condition) label; null for what is not used."""
    return F.when(disease == "NO", "NORMAL").when(disease == "DME", "DME").when((disease == "AMD") & (condition == "drusen"), "DRUSEN").when((disease == "AMD") & (condition == "MNV"), "CNV")


def mapped(labels: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Labelled rows of a known class whose file exists."""
    return labels.withColumn("class", map_label(F.col("disease"), F.col("condition"))).filter("class is not null").join(listing, key, "left_semi")


def name_label(name: Column, classes: tuple[str, ...] = CLASSES) -> Column:
    """The first token of a name if it is a class, else null."""
    token = F.substring_index(F.substring_index(name, "_", 1), "-", 1)
    return F.when(token.isin(*classes), token)


def label_id(label: Column, classes: tuple[str, ...] = CLASSES) -> Column:
    """0-based id; null for an unknown class."""
    return F.nullif(F.array_position(F.array(*map(F.lit, classes)), label) - 1, F.lit(-1))


def class_weights(rows: DataFrame, column: str, classes: tuple[str, ...]) -> DataFrame:
    """class and total / (classes * count), a missing class counted as 1."""
    known = rows.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    counted = rows.groupBy(F.col(column).alias("class")).agg(F.count("*").alias("n"))
    joined = known.join(F.broadcast(counted), "class", "left").na.fill(0, ["n"])  # one row per class
    total = F.broadcast(joined.agg(F.sum("n").alias("total")))
    return joined.crossJoin(total).select("class", F.round(F.col("total") / (len(classes) * F.greatest("n", F.lit(1))), 6).alias("weight"))


def subsample(rows: DataFrame, n: int, by: str, key: str, seed: int = 0) -> DataFrame:
    """n rows of each class without replacement, the first in seeded order."""
    return ranked(rows, key, seed, [by]).filter(F.col("rank") <= n).drop("rank")


def tag(crop: Column, curvature: Column, fit: Column, width: Column, height: Column) -> Column:
    """The name of a preprocessing configuration; curvature counts only with a crop."""
    return F.concat_ws("_", F.when(crop, "crop").otherwise("full"), F.when(crop & curvature, "curv").otherwise("flat"), fit, F.concat(width, F.lit("x"), height))
