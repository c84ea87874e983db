"""Hard negatives for contrastive training, by segment summary filtering.

Every vector is stored with the mean and the deviation of its segments, at several levels of ever shorter
segments. Over a segment of n components the inner product of two vectors is n times the product of the
means, plus or minus at most n times the product of the deviations; summed over the segments that bounds
their score from both sides. A level of few segments costs a fraction of the score itself, and only pairs that
its bounds leave open go on to the next level; what is open after the last is scored exactly. So nothing is
lost: the result is that of scoring all pairs.

The first search finds each anchor's positives, its best rows of the same label: a row is out once its
upper bound is below the k-th best lower bound. The second finds, for each positive, the best rows of other
labels whose scores lie within a share of the positive's: a row is out once its bounds miss every such
range, or lie below the k-th best lower bound of the rows surely in it.

Rows with a null id, label or vector or with null or non-finite components take no part. Rows that share an
anchor's id are its own and no candidates; of several rows of an anchor's id the least (label, vector) is the
anchor. Other repeated rows each count. Ties go to the smaller id, shorter vectors end in zeros, and extra
columns are not looked at. An empty table, or one without anchors or negatives, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import durable
from lectern.llm.vectors import first_k, scores, usable, whole
from lectern.operators.blocks import SENT_BYTES, against_all, best_rows, matrix, same_width

#: Components of a segment at each level, coarse to fine.
LENGTHS = (16, 4)
SUMMARY = [f"{what}_{n}" for n in LENGTHS for what in ("mean", "deviation")]
#: Share of the product of two vectors' lengths by which rounding may falsify a bound.
SLACK = 1e-5
FOUND = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("item", pa.int64()), ("score", pa.int64()), ("positive_score", pa.int64())])


def segments(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of every row; rows end in zeros."""
    parts = np.pad(x.astype(np.float64), ((0, 0), (0, -x.shape[1] % length))).reshape(len(x), -1, length)
    return parts.mean(axis=2), parts.std(axis=2)


def index(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, whole (floor(scale * x) of each component) and the SUMMARY columns of the usable rows; map-only."""
    given = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("whole"))

    def listed(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = whole(batch["whole"], scale)
            made = [part.astype(np.float32) for n in LENGTHS for part in segments(own, n)]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], *map(listed, [own, *made])], names=["vec_id", "label", "whole", *SUMMARY])

    usable_rows = given.filter("vec_id is not null and label is not null").filter(usable("whole"))
    return usable_rows.mapInArrow(run, f"vec_id bigint, label bigint, whole array<bigint>, {', '.join(f'{c} array<float>' for c in SUMMARY)}")


class Pairs:
    """Pairs of rows and anchors that may still count, narrowed level by level, then scored."""

    def __init__(self, held: pa.Table, wanted: pa.Table, open_pairs: np.ndarray):
        self.held, self.wanted, self.open = held, wanted, open_pairs
        self.x, self.a = same_width(matrix(held["whole"]), matrix(wanted["asked"]))
        self.slack = SLACK * (1 + np.linalg.norm(self.x, axis=1))[:, None] * (1 + np.linalg.norm(self.a, axis=1))[None, :]

    def bounds(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows and anchors with open pairs, and lower and upper bounds of their scores."""
        i, j = np.flatnonzero(self.open.any(axis=1)), np.flatnonzero(self.open.any(axis=0))
        (m, am), (d, ad) = (same_width(matrix(self.held[f"{c}_{length}"].take(pa.array(i))), matrix(self.wanted[f"{c}_{length}"].take(pa.array(j)))) for c in ("mean", "deviation"))
        middle, apart, slack = m @ am.T, d @ ad.T, self.slack[np.ix_(i, j)]
        return i, j, length * (middle - apart) - slack, length * (middle + apart) + slack

    def exact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and anchors with open pairs, and their exact scores."""
        i, j = np.flatnonzero(self.open.any(axis=1)), np.flatnonzero(self.open.any(axis=0))
        return i, j, scores(self.x[i].astype(np.int64), self.a[j].astype(np.int64))


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest value of each column, or less than any where there are fewer."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else np.full(values.shape[1], -np.inf)


def _near(held: pa.Table, wanted: pa.Table, k: int) -> pa.Table:
    """The k best rows of the label of each anchor."""
    if not held.num_rows or not wanted.num_rows:
        return FOUND.empty_table()
    ids, anchors = held["vec_id"].to_numpy(), wanted["anchor_id"].to_numpy()
    alike = held["label"].to_numpy()[:, None] == wanted["label"].to_numpy()[None, :]
    pairs = Pairs(held, wanted, alike & (ids[:, None] != anchors[None, :]))
    for length in LENGTHS:
        i, j, low, high = pairs.bounds(length)
        own = pairs.open[np.ix_(i, j)]
        pairs.open[np.ix_(i, j)] = own & (high >= kth(np.where(own, low, -np.inf), k))
    i, j, score = pairs.exact()
    row, column = first_k(score, pairs.open[np.ix_(i, j)], k)
    found = [anchors[j[column]], np.zeros(len(row), np.int64), ids[i[row]], score[row, column], np.zeros(len(row), np.int64)]
    return pa.table(found, schema=FOUND)


def _hard(held: pa.Table, wanted: pa.Table, k: int, low_percent: int, high_percent: int) -> pa.Table:
    """For each positive of each anchor the k best rows of other labels within its range."""
    if not held.num_rows or not wanted.num_rows:
        return FOUND.empty_table()
    ids, anchors = held["vec_id"].to_numpy(), wanted["anchor_id"].to_numpy()
    most = wanted["positives"].combine_chunks()
    many = most.value_lengths().to_numpy()
    flat_id, flat_score = (most.flatten().field(c).to_numpy() for c in ("item", "score"))
    place = np.arange(many.max(initial=0))
    positive = np.zeros((len(place), len(many)), np.int64)
    positive_id, there = positive.copy(), place[:, None] < many[None, :]
    positive_id.T[there.T], positive.T[there.T] = flat_id, flat_score
    there[1:] &= (positive_id[1:] != positive_id[:-1]) | (positive[1:] != positive[:-1])  # a repeated row is one positive
    alike = held["label"].to_numpy()[:, None] == wanted["label"].to_numpy()[None, :]
    pairs = Pairs(held, wanted, ~alike & there.any(axis=0)[None, :] & (ids[:, None] != anchors[None, :]))
    for length in LENGTHS:
        i, j, low, high = pairs.bounds(length)
        own, may = pairs.open[np.ix_(i, j)], np.zeros((len(i), len(j)), bool)
        for p, given in zip(positive[:, j], there[:, j], strict=True):
            floor, ceiling = low_percent * p / 100, high_percent * p / 100
            inside = own & given & (low >= floor) & (high <= ceiling)
            least = np.maximum(floor, kth(np.where(inside, low, -np.inf), k))
            may |= given & (high >= least) & (low <= ceiling)
        pairs.open[np.ix_(i, j)] = own & may
    i, j, score = pairs.exact()
    own, out = pairs.open[np.ix_(i, j)], []
    for p, name, given in zip(positive[:, j], positive_id[:, j], there[:, j], strict=True):
        fits = own & given & (low_percent * p <= 100 * score) & (100 * score <= high_percent * p)
        row, column = first_k(score, fits, k)
        out.append(pa.table([anchors[j[column]], name[column], ids[i[row]], score[row, column], p[column]], schema=FOUND))
    return pa.concat_tables(out) if out else FOUND.empty_table()


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, scale: int = 256, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    rows: vec_id, label, embedding; `anchor` tells by vec_id which rows are anchors. The positives of an anchor are its first
    rows of the same label by score; the negatives of a positive are the first rows of other labels with
    low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score. The index is
    written once in the shared folder and read by both searches.
    """
    stored = durable(index(rows, scale))
    own = stored.filter(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "whole", *SUMMARY)).alias("least"))
    anchors = durable(own.select(F.col("vec_id").alias("anchor_id"), "least.label", F.col("least.whole").alias("asked"), *[f"least.{c}" for c in SUMMARY]))
    kind = "anchor_id bigint, positive_id bigint, item bigint, score bigint, positive_score bigint"
    # An anchor is sent with its summaries, about as many numbers again as its vector has.
    sent = sent_bytes // 2

    def first(found: DataFrame, k: int, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "item"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    near = against_all(stored, "vec_id", anchors, "anchor_id", lambda held, wanted: _near(_sorted(held), wanted, positives), lambda t: best_rows(t, positives, ["anchor_id"], "score", "item"), kind, sent_bytes=sent)
    chosen = first(near, positives, "anchor_id").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("positives"))
    given = durable(anchors.join(chosen, "anchor_id"))
    hard = against_all(stored, "vec_id", given, "anchor_id", lambda held, wanted: _hard(_sorted(held), wanted, negatives, low_percent, high_percent), lambda t: best_rows(t, negatives, ["anchor_id", "positive_id", "positive_score"], "score", "item"), kind, sent_bytes=sent)
    ranked = first(hard, negatives, "anchor_id", "positive_id", "positive_score")
    return ranked.select("anchor_id", "positive_id", "rank", F.col("item").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _sorted(held: pa.Table) -> pa.Table:
    """By id, as of equal scores the upper row comes first."""
    return held.sort_by("vec_id")
