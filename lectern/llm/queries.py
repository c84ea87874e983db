"""Queries of this subpackage over the driver's tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from lectern.llm import audio_fingerprint, conversation_repair, hard_negatives, license_scan, packing, pii, quality_classifier, quality_rules, sentencepiece_bpe, simhash, token_counts, url_filter, voronoi
from lectern.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECE_BPE)
    both = sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), model, keep=["doc_id"], decoded="decoded")
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words_each=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.with_score(docs, machine, ["doc_id"])
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    listed = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    place = F.col("base.place")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        listed(F.col("base.label")).alias("base_labels"),
        listed(F.concat("base.label", "detections.label")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(1 - F.aggregate("detections.confidence", F.lit(1.0), lambda left, c: left * (1 - c))).alias("score"),
    )


def op9_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    narrow = lambda spans, kind: F.transform(spans, lambda s: F.struct(kind(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = narrow(F.col("base"), lambda s: s["kind"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    every = F.concat(base, narrow(F.col("terms"), lambda s: F.lit(pii.TERM)))
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(every).alias("spans"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after four edits each: a removal, an insertion, a replacement and an addition at the end."""
    tokenizer = public_tokenizers.path(BYTE_BPE)
    trees = token_counts.build(table(spark, sf_dir, "documents"), tokenizer)
    size = F.length("text")
    place = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), size + 1).cast("int")
    change = lambda start, length, put: F.struct(start.alias("start"), (start + length).alias("end"), put.alias("put"))
    edits = F.array(
        change(place(1), F.lit(20), F.lit("")),
        change(place(2), F.lit(0), F.substring("text", 1, 30)),
        change(place(3), F.lit(12), F.lit(" it's\n 42")),
        change(size + 100, F.lit(0), F.lit(" The end.")),
    )
    edited = token_counts.apply_edits(trees.withColumn("edits", edits), tokenizer)
    return edited.select("doc_id", "n_before", F.col("n_tokens").alias("n_after"), "n_reencoded", F.size("leaf_chars").cast("bigint").alias("n_leaves"))


def op8_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes taken as 8-bit samples; ids divisible by 50 are the recordings searched for."""
    recordings = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("samples"))
    found = audio_fingerprint.matches(audio_fingerprint.fingerprint(recordings), F.col("key") % 50 == 0)
    return found.withColumnsRenamed({"key": "doc_id", "query": "query_id"})


USABLE = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def op11_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_scores(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


TOP_K = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings WHERE {USABLE}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.w, v.w)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", noisy), F.col("vec_id") % 100 == 0)


HARD = f"""WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings WHERE label IS NOT NULL AND {USABLE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, v.vec_id AS item, a.label = v.label AS alike, list_inner_product(a.w, v.w)::BIGINT AS score FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT anchor_id, item AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, item) AS place FROM s WHERE alike) WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, item AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, item)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score) WHERE rank <= 5"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(conversations), conversations.select("conv_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": url_filter.sql(), "op11_voronoi_top_k": TOP_K, "op12_hard_negatives": HARD, "op13_conversation_repair": conversation_repair.SQL}
