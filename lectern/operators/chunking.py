"""Passages: one row per document in, one row per passage out. The fold over a document's sentences is a small
helper inside a map, so nothing is shuffled whatever the length of an article."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.plugins import Embed

STRATEGIES = ("fixed", "section", "semantic")
FIXED_WORDS, FIXED_OVERLAP, MAX_WORDS, WINDOW_WORDS, CUT_PERCENTILE = 200, 40, 300, 250, 90
META = ["doc_id", "title", "doi", "license"]
SLICE = 64


def units(articles: DataFrame) -> DataFrame:
    """(pmcid, section_no, sentence_no, section, sentence, words), one row per sentence in reading order."""
    parts = articles.select("pmcid", F.posexplode("sections").alias("section_no", "s"))
    said = parts.select("pmcid", "section_no", F.col("s.heading").alias("section"), F.posexplode(tx.sentences(F.col("s.text"))).alias("sentence_no", "sentence"))
    return said.withColumn("words", tx.word_count(F.col("sentence")))


def unit_arrays(articles: DataFrame) -> DataFrame:
    """One row per article with its units as an array; section_no tells equal headings of different entries apart."""
    nested = F.transform(
        F.col("sections"),
        lambda s, i: F.transform(tx.sentences(s["text"]), lambda t: F.struct(i.alias("section_no"), s["heading"].alias("section"), t.alias("sentence"), tx.word_count(t).alias("words"))),
    )
    return articles.select(F.col("pmcid").alias("doc_id"), "title", "doi", "license", F.flatten(nested).alias("units"))


Passages = Iterator[tuple[str, list[str]]]
Fold = Callable[[list[str], list[int], list[str], list[int]], Passages]


def _by_size(size: int, overlap: int) -> Fold:
    def fold(section: list[str], number: list[int], said: list[str], words: list[int]) -> Passages:
        start, held = 0, 0
        for i, w in enumerate(words):
            if i > start and held + w > size:
                yield section[start], said[start:i]
                carried, back = 0, i
                while back > start and carried < overlap:
                    back -= 1
                    carried += words[back]
                start, held = back, carried
            held += w
        if start < len(said):
            yield section[start], said[start:]

    return fold


def _within(size: int, same: Callable[[list[str], list[int], int], bool]) -> Fold:
    """A new passage where `same` is false between a unit and the one before, or the size would be passed."""

    def fold(section: list[str], number: list[int], said: list[str], words: list[int]) -> Passages:
        start, held = 0, 0
        for i, w in enumerate(words):
            if i > start and (held + w > size or not same(section, number, i)):
                yield section[start], said[start:i]
                start, held = i, 0
            held += w
        if said:
            yield section[start], said[start:]

    return fold


def _by_meaning(size: int, percentile: float, embed: Embed) -> Fold:
    def fold(section: list[str], number: list[int], said: list[str], words: list[int]) -> Passages:
        if len(said) < 2:
            cut = np.zeros(len(said), bool)
        else:
            v = np.asarray(embed(said), np.float32)
            v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)
            apart = 1 - (v[1:] * v[:-1]).sum(axis=1)
            cut = np.concatenate([[False], apart >= np.percentile(apart, percentile)])
        yield from _within(size, lambda _s, _n, i: not cut[i])(section, number, said, words)

    return fold


def _fold(articles: DataFrame, fold: Fold) -> DataFrame:
    kinds = pa.schema([(c, pa.string()) for c in (*META, "section", "text")] + [("chunk_index", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = []
                for row in batch.slice(at, SLICE).to_pylist():
                    own = row["units"] or []
                    columns = ([u[c] for u in own] for c in ("section", "section_no", "sentence", "words"))
                    for k, (section, said) in enumerate(fold(*columns)):
                        out.append({**{c: row[c] for c in META}, "section": section, "text": " ".join(said), "chunk_index": k})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return unit_arrays(articles).mapInArrow(run, "doc_id string, title string, doi string, license string, section string, text string, chunk_index int")


def chunk(articles: DataFrame, strategy: str = "section", size: int = FIXED_WORDS, overlap: int = FIXED_OVERLAP, max_size: int = MAX_WORDS, threshold: float = CUT_PERCENTILE, embed: Embed | None = None) -> DataFrame:
    """Passages of articles: doc_id, title, doi, license, section, text, chunk_index.

    fixed: up to `size` words, with trailing sentences carried until they hold `overlap` words. section:
    never across consecutive different headings, up to `max_size` words. semantic: cut where neighbouring
    sentences are at least as far apart as the document's `threshold` percentile. A sentence longer than
    the size stays whole. Documents without sentences give no passages.
    """
    if strategy == "fixed":
        return _fold(articles, _by_size(size, overlap))
    if strategy == "section":
        return _fold(articles, _within(max_size, lambda section, _n, i: section[i] == section[i - 1]))
    if strategy == "semantic":
        if embed is None:
            raise ValueError("the semantic strategy needs an embed function")
        return _fold(articles, _by_meaning(max_size, threshold, embed))
    raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")


def seed_windows(articles: DataFrame, words: int = WINDOW_WORDS) -> DataFrame:
    """Whole sentences up to `words`, never across a section entry; chunk_index runs over the article."""
    return _fold(articles, _within(words, lambda _s, number, i: number[i] == number[i - 1]))


def length_stats(passages: DataFrame, *keys: str) -> DataFrame:
    n = tx.word_count(F.col("text"))
    return passages.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(n)).cast("bigint").alias("mean_words"), F.min(n).cast("bigint").alias("min_words"), F.max(n).cast("bigint").alias("max_words"))


def length_histogram(passages: DataFrame, bins: int = 30, key: str = "strategy") -> DataFrame:
    """bin (0-based) and n over the range of each key; the top edge falls into the last bin."""
    sized = passages.select(key, tx.word_count(F.col("text")).cast("double").alias("w"))
    ends = sized.groupBy(key).agg(F.min("w").alias("low"), F.max("w").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("w") - F.col("low")) / width), F.lit(bins - 1))).otherwise(0)
    return sized.join(ends, key).groupBy(key, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
