"""Quality classifier: a factorisation machine over hashed words, structure statistics and one metadata field.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): the pairwise
interactions cost time linear in the features through the sum-of-squares identity. Fitting uses a bounded
sample of labelled rows (SAMPLE_ROWS, the rows with the smallest hashes of their id); scoring is map-only
over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import slices

#: Labelled rows used for fitting, at most; their features are all that is gathered.
SAMPLE_ROWS = 8_000
WORD_BUCKETS = 4_096
RANK = 8
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.08, 1e-4
#: Statistics of a text, each cut into this many equal steps of its transformed range 0..1.
STEPS = 16
STATISTICS = ("symbols", "exclaims", "upper", "digits", "unlike", "stutter", "repeated_lines", "word_length", "words", "bars", "declared_length")
FEATURES = WORD_BUCKETS + STEPS * len(STATISTICS)


def statistics(raw: bytes, words: list[bytes], declared: int | None) -> list[float]:
    """Values in 0..1, in the order of STATISTICS."""
    n, size = max(len(words), 1), max(len(raw), 1)
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    log = lambda x, top: min(1.0, np.log1p(x) / np.log1p(top))
    return [
        log(20 * without(b"#*$%&<>") / n, 60),
        log(20 * raw.count(b"!") / n, 60),
        min(1.0, without(bytes(range(65, 91))) / size),
        min(1.0, 4 * without(b"0123456789") / size),
        len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        min(1.0, size / n / 16),
        log(len(words), 20_000),
        log(20 * raw.count(b"|") / n, 60),
        0.0 if declared is None or declared < 0 else log(declared, 200_000),
    ]


def features(text: str, declared: int | None) -> np.ndarray:
    """Dense features of a whole text: word shares by hash bucket, then one step of each statistic."""
    raw = text.encode()
    words = raw.split()
    x = np.zeros(FEATURES, np.float32)
    if words:
        buckets = np.fromiter(map(crc32, words), np.int64, len(words)) % WORD_BUCKETS
        x[:WORD_BUCKETS] = np.bincount(buckets, minlength=WORD_BUCKETS) / len(words)
    for k, value in enumerate(statistics(raw, words, declared)):
        x[WORD_BUCKETS + STEPS * k + min(int(value * STEPS), STEPS - 1)] = 0.5
    return x


@dataclass
class Machine:
    """Fitted weights; FEATURES x (RANK + 1) numbers, whatever the corpus."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        summed = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * (summed**2 - (x**2) @ (self.factors**2)).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> Machine:
    """AdaGrad on the log loss over sparse rows (indices, values). With one class only, a constant."""
    rng = np.random.default_rng(seed)
    rate = (y.sum() + 1) / (len(y) + 2)
    own = Machine(float(np.log(rate / (1 - rate))), np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32))
    if len(set(y.tolist())) < 2:
        own.factors[:] = 0
        return own
    past_linear, past_factors = np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, RANK), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            batch = np.zeros((len(rows), FEATURES), np.float32)
            for k, i in enumerate(rows):
                batch[k, x[i][0]] = x[i][1]
            used = np.flatnonzero(batch.any(axis=0))
            part, v = batch[:, used], own.factors[used]
            summed = part @ v
            logit = own.bias + part @ own.linear[used] + 0.5 * (summed**2 - (part**2) @ (v**2)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]).astype(np.float32) / len(rows)
            step_linear = part.T @ error + DECAY * own.linear[used]
            step_factors = part.T @ (error[:, None] * summed) - v * ((part**2).T @ error)[:, None] + DECAY * v
            past_linear[used] += step_linear**2
            past_factors[used] += step_factors**2
            own.linear[used] -= RATE * step_linear / np.sqrt(past_linear[used])
            own.factors[used] -= RATE * step_factors / np.sqrt(past_factors[used])
            own.bias -= RATE * float(error.sum())
    return own


def held_out() -> F.Column:
    """True for the rows that no label may be learnt from. A null id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fits on at most `sample_rows` labelled rows that are not held out.

    Rows are chosen by a hash of their id from the narrow label table, so only their texts are read for
    features. Null labels, labels without a document and repeated labels add nothing.
    """
    usable = labels.filter(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = _narrow(docs).join(F.broadcast(sample), "doc_id").select("quality", "text", "n_chars")  # at most sample_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [features(t or "", n) for t, n in zip(part[1].to_pylist(), part[2].to_pylist(), strict=True)]
            used = [np.flatnonzero(x) for x in found]
            yield pa.RecordBatch.from_arrays([part[0], pa.array(used, pa.list_(pa.int32())), pa.array([x[u] for x, u in zip(found, used, strict=True)], pa.list_(pa.float32()))], names=["y", "i", "v"])

    got = rows.mapInArrow(run, "y int, i array<int>, v array<float>").toArrow()
    pairs = [(np.asarray(i.values), np.asarray(v.values)) for i, v in zip(got["i"], got["v"], strict=True)]
    y = np.array(got["y"].to_pylist(), np.float32)
    order = sorted(range(len(y)), key=lambda k: (y[k], pairs[k][0].tobytes(), pairs[k][1].tobytes()))  # the same for any partitioning
    return fit([pairs[k] for k in order], y[order]) if len(y) else fit([], np.zeros(0, np.float32))


def _narrow(docs: DataFrame) -> DataFrame:
    declared = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), declared.alias("n_chars"))


def with_score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns `keep` and score; map-only. Null and empty texts are scored by what they lack. A column `score` is replaced."""
    kept = [c for c in keep if c != "score"]
    declared = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias("_scored_text"), declared.alias("_scored_length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = np.stack([features(t or "", n) for t, n in zip(part[len(kept)].to_pylist(), part[len(kept) + 1].to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(machine.score(x).astype(float))], names=[*kept, "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-2], T.StructField("score", T.DoubleType())]))


def filter_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that score at least `least`, with all their columns; fitted on labels of rows not held out."""
    whole = docs.select(F.col("text"), *([F.col("n_chars")] if "n_chars" in docs.columns else []), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return with_score(whole, learn(docs, labels), ["_row"]).filter(F.col("score") >= least).select("_row.*")
