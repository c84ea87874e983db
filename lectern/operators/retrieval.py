"""Dense search, rank fusion, reranking, pooled searches and passage texts, for all queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.blocks import SENT_BYTES, against_all, best_rows, matrix, same_width
from lectern.operators.lexical import bm25_search, top_k

MODES = ("vector", "bm25", "hybrid")
RRF_K, CANDIDATES, ROUNDS = 60, 50, 5
FOUND = pa.schema([("query_id", pa.int64()), ("item", pa.int64()), ("score", pa.float64())])
NONE_FOUND = "No relevant passages found."


def normalise(vector: Column, extra: float = 0.0) -> Column:
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x)) + extra
    return F.transform(vector, lambda x: x / size)


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 50, key: str = "item_id", vector: str = "embedding", without_self: bool = False, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """query_id, `key`, score and rank of the k nearest rows by inner product of every query (query_id, vector).

    Few queries are sent to where the rows are and the rows are not moved; more than `sent_bytes` of them meet
    the rows in blocks (`blocks.against_all`). Scores round to 6 places, ties go by key. Rows without a key or a vector are left out.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("item"), F.col(vector).alias("own")).filter("own is not null and item is not null")
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").alias("asked")).filter("asked is not null and query_id is not null")

    def score(held: pa.Table, wanted: pa.Table) -> pa.Table:
        if not held.num_rows or not wanted.num_rows:
            return FOUND.empty_table()
        ids, own = wanted["query_id"].to_numpy(), held["item"].to_numpy()
        q, x = same_width(matrix(wanted["asked"]), matrix(held["own"]))
        scores = np.round(x @ q.T, 6)
        if without_self:
            scores[own[:, None] == ids[None, :]] = -np.inf
        # Ties at the k-th place must all stay until the order by key.
        limit = np.partition(scores, max(0, len(own) - k), axis=0)[max(0, len(own) - k)]
        i, j = np.nonzero((scores >= limit) & np.isfinite(scores))
        return best(pa.table({"query_id": ids[j], "item": own[i], "score": scores[i, j]}))

    def best(found: pa.Table) -> pa.Table:
        return best_rows(found, k, ["query_id"], "score", "item")

    found = against_all(rows, "item", asked, "query_id", score, best, "query_id bigint, item bigint, score double", sent_bytes=sent_bytes)
    return top_k(found, k, "query_id", [F.desc("score"), F.col("item")])


def rrf(first: DataFrame, second: DataFrame, keys: list[str], k: int = 50, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, keys, rank); ties: the first ranking's order, then the second's."""
    one = first.select("query_id", *keys, F.col("rank").alias("a"), F.lit(None).cast("int").alias("b"))
    two = second.select("query_id", *keys, F.lit(None).cast("int").alias("a"), F.col("rank").alias("b"))
    both = one.unionByName(two).groupBy("query_id", *keys).agg(F.min("a").alias("first_rank"), F.min("b").alias("second_rank"))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", part("first_rank") + part("second_rank"))
    order = [F.desc(F.round("score", 9)), F.asc_nulls_last("first_rank"), F.asc_nulls_last("second_rank")]
    return top_k(scored, k, "query_id", order)


def rerank(hits: DataFrame, logit: Column, k: int | None = None, by: str = "query_id") -> DataFrame:
    """Hits ordered by a scorer's logits (equal ones keep their order), reported as a sigmoid, ranked anew."""
    scored = hits.withColumn("_logit", logit)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_logit"), "rank"))
    out = scored.withColumn("_new", rank).withColumn("score", 1 / (1 + F.exp(-F.col("_logit")))).withColumn("rank", F.col("_new")).drop("_new", "_logit")
    return out if k is None else out.filter(F.col("rank") <= k)


def retrieve(passages: DataFrame, queries: DataFrame, mode: str, k: int = 50, candidates: int = CANDIDATES, key: str = "passage_id") -> DataFrame:
    """query_id, `key`, score and rank by mode. passages: `key`, text, embedding; queries: query_id, query, vector."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    columns = ["query_id", key, "score", "rank"]
    vector = lambda n: vector_search(passages, queries, n, key).withColumnRenamed("item", key)
    words = lambda n: bm25_search(passages, queries, [key], n)
    if mode == "vector":
        return vector(k).select(columns)
    if mode == "bm25":
        return words(k).select(columns)
    return rrf(vector(candidates), words(candidates), [key], k).select(columns)


def pooled(rounds: DataFrame, most: int = ROUNDS) -> DataFrame:
    """Rows (question, round, query, ...) of the searches that run: from the second on a search that repeats an
    earlier one (white space at the ends and case aside) or is empty stops the question, as does the cap."""
    said = F.lower(F.trim("query"))
    seen = F.row_number().over(Window.partitionBy("question", said).orderBy("round"))
    stop = ((seen > 1) | (said == "")).cast("int")
    marked = rounds.withColumn("_stop", stop)
    before = F.max("_stop").over(Window.partitionBy("question").orderBy("round").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_stopped", before).filter((F.col("_stopped") == 0) & (F.col("round") <= most)).drop("_stop", "_stopped")


def pool(hits: DataFrame, by: str = "question") -> DataFrame:
    """Each passage of a question's searches once, where it was first seen, in that order."""
    first = F.row_number().over(Window.partitionBy(by, "doc_id", "text").orderBy("round", "rank"))
    kept = hits.withColumn("_first", first).filter("_first = 1").drop("_first")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("round", "rank")))


def format_passages(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id and the numbered passages as one text; a query without hits says so. Hits are at most the k of their search."""
    source = F.when(F.coalesce("section", F.lit("")) != "", F.concat_ws(" - ", "title", "section")).otherwise(F.col("title"))
    block = F.concat(F.lit("["), "rank", F.lit("] ("), source, F.lit(")\n"), "text")
    listed = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    texts = hits.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("passages"))
    return queries.select("query_id").join(texts, "query_id", "left").select("query_id", F.coalesce("passages", F.lit(NONE_FOUND)).alias("passages"))


def source_summary(hits: DataFrame, by: str = "query_id") -> DataFrame:
    best = F.max("score")
    return hits.groupBy(by).agg(
        F.count("*").alias("passages"), F.countDistinct("doc_id").alias("articles"), F.round(100 * best).cast("int").alias("best_percent"),
        F.when(best >= 0.8, "high").when(best >= 0.5, "mid").otherwise("low").alias("band"),
    )
