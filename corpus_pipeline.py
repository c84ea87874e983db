"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes all rows that the one before kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import packing, pii, quality_classifier, quality_rules, simhash
from lectern.llm.common import table
from lectern.operators.durable import delete_folder, new_folder

TOKENIZER = "byte_bpe_50k.json"
#: Shingles of five words; texts are linked at a Jaccard similarity of 0.8 or more of their sets.
SHINGLE_WORDS = 5
#: Only rows that the classifier is sure to be bad go.
LEAST_SCORE = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality_classifier.filter_documents(docs, table(spark, sf_dir, "labels"), LEAST_SCORE)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rules or a risk-controlled one."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.keep_one(docs, SHINGLE_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and the words that reveal it, in the texts."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the tokeniser; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; a stage's folder is deleted once the next one is written."""
    folder, before = new_folder(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
