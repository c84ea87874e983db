"""Files: corpora, manifests, status logs, question sets, split tables and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.corpus import manifest, repair

STORED = "pmcid string, title string, doi string, license string, journal string, sections array<array<string>>"
QUESTION = (
    "id string, question string, ground_truth string, source_doc_id string, source_section string, evidence string, subspecialty string, "
    "category string, split string, answer_sentences array<string>, gold_chunks map<string,array<bigint>>, gold_match map<string,string>"
)


def _sections(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sections", F.transform("sections", lambda s: F.struct(s[0].alias("heading"), s[1].alias("text"))))


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Articles of JSON lines, whose sections are pairs."""
    return _sections(spark.read.schema(STORED).json(path))


def save_corpus(articles: DataFrame, path: str) -> None:
    """JSON lines that `load_corpus` reads back."""
    articles.withColumn("sections", F.transform("sections", lambda s: F.array(s["heading"], s["text"]))).write.mode("overwrite").json(path)


def save_manifest(articles: DataFrame, path: str) -> None:
    manifest(articles).write.mode("overwrite").option("header", True).csv(path)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """value and line of every line of the files at `path`; line tells the order in which they were written.

    Spark reads large files first and cuts long ones, so the order is that of the files' times, then of their names
    (parts of one write are numbered), then of the place in the file: where its block starts, and the row in it.
    """
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select("value", place.alias("line"))


def repair_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a damaged file: lines that cannot be read are dropped, the record of an id that was written last wins."""
    parsed = lines_of(spark, path).select("line", F.from_json("value", f"{STORED}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("r")).select("line", "r.*")
    return _sections(repair(parsed))


def read_status_log(spark: SparkSession, path: str) -> DataFrame:
    """pmcid, status and line of a tab-separated log; a line cut short has a null status."""
    parts = F.split("value", "\t", -1)
    return lines_of(spark, path).select(F.get(parts, F.lit(0)).alias("pmcid"), F.get(parts, F.lit(1)).alias("status"), "line")


def append_status(rows: DataFrame, path: str) -> None:
    rows.select("pmcid", "status").write.mode("append").option("sep", "\t").csv(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON lines; fields that older files lack get empty values."""
    rows = spark.read.schema(QUESTION).json(path)
    empty = {"string": F.lit(""), "array<string>": F.array().cast("array<string>"), "map<string,array<bigint>>": F.create_map().cast("map<string,array<bigint>>"), "map<string,string>": F.create_map().cast("map<string,string>")}
    return rows.select(*[F.coalesce(c, empty[kind]).alias(c) for c, kind in rows.dtypes])


def write_questions(rows: DataFrame, path: str, replace: bool = False) -> None:
    rows.write.mode("overwrite" if replace else "errorifexists").json(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.schema("name string, class string, patient string, split string").option("header", True).csv(path)
    return rows if split is None else rows.filter(F.col("split") == split)


def write_split(rows: DataFrame, path: str) -> None:
    rows.select("name", "class", "patient", "split").write.mode("overwrite").option("header", True).csv(path)


def list_scans(spark: SparkSession, folder: str, pattern: str = "*.jpeg") -> DataFrame:
    """path, class (its folder) and name of image files; their bytes are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")
    parts = F.split("path", "/")
    return found.select("path", F.element_at(parts, -2).alias("class"), F.element_at(parts, -1).alias("name"))
