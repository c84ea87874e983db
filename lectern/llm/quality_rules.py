"""Quality rules whose cutoffs come with a guarantee on how many good documents they reject.

For every stratum and rule a fixed grid of cutoffs is tested from the loosest to the strictest. A cutoff
passes if the labelled good documents (the holdout: no rule is fitted on them) reject the hypothesis that
it takes more than the rule's share of the allowed risk, by the exact binomial tail, at a level divided
by the number of rules and strata (Bonferroni); testing stops at the first that fails, so no further
correction is needed along the grid. The strictest that passed is the cutoff; a rule without one is not
applied in that stratum. With probability 1 - delta, at most `risk` of the good documents of each stratum
are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import durable, slices

RISK, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEATED = 50, 50
#: Strata whose cutoffs are sent to every executor; more are joined by a shuffle.
BROADCAST_STRATA = 10_000

#: Rule: (its value, cutoffs from the loosest to the strictest). A document fails if its value is above the cutoff.
RATIOS = [2.0**k for k in range(1, -9, -1)]

STATS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")])


def rules() -> dict[str, tuple]:
    per_word = lambda c: F.try_divide(F.col(c), F.col("n_words"))
    return {
        "symbols": (per_word("n_symbols"), RATIOS),
        "exclaims": (per_word("n_exclaims"), RATIOS),
        "upper": (F.try_divide(F.col("n_upper"), F.col("word_chars")), [1 - k / 20 for k in range(1, 20)]),
        "dup_lines": (F.try_divide(F.col("n_dup_lines"), F.col("n_lines")), [1 - k / 20 for k in range(1, 20)]),
        "repeats": (per_word("n_repeat_words"), [1 - k / 20 for k in range(1, 20)]),
        "word_length": (per_word("word_chars"), [30 - k for k in range(24)]),
    }


UPPER = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more, the first place included."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) > 2_000_000:  # three ids would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * len(known) + ids[2:]
    _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    if len(count) == len(keys):
        return 0
    twice = count[place] > 1
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[k : k + len(keys)] |= twice
    return int(marked.sum())


def text_stats(text: str) -> tuple[int, ...]:
    """The fields of STATS for one whole text."""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return len(words), len(text) - without(b" \t\n\v\f\r"), without(b"#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(words), len(lines), without(UPPER), raw.count(b"!")


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and STATS; map-only. A null text has no words. STATS names in `keep` are replaced."""
    kept = [c for c in keep if c not in STATS.names]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias("_stats_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [text_stats(x or "") for x in part[len(kept)].to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=[*kept, *STATS.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *STATS.fields]))


def tail(k: int, n: int, risk: float) -> float:
    """P(Binomial(n, risk) <= k), exactly."""
    if k >= n * risk:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk)
    return min(1.0, math.fsum(math.exp(log(i)) for i in range(k + 1)))


def cutoffs(stats: DataFrame, labels: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum that has good labels: `stratum` and, per rule, its cutoff (null: not applied).

    stats has doc_id, `stratum` and STATS; labels has doc_id and quality. Labels without a document, with
    a null id or not of quality 1 count nowhere; repeated ones count once.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct()
    known = stats.join(good, "doc_id", "left_semi").groupBy(stratum)
    sums = [F.count(F.when(value > cut, 1)).alias(f"{name}_{i}") for name, (value, cuts) in rules().items() for i, cut in enumerate(cuts)]
    counts = durable(known.agg(F.count("*").alias("n"), *sums))
    grid = {name: cuts for name, (_, cuts) in rules().items()}
    level = delta / max(1, counts.count() * len(grid))

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = part[[stratum]].copy()
            for name, cuts in grid.items():
                chosen = []
                for _, row in part.iterrows():
                    passed = None
                    for i, cut in enumerate(cuts):
                        if tail(int(row[f"{name}_{i}"]), int(row["n"]), risk / len(grid)) > level:
                            break
                        passed = cut
                    chosen.append(passed)
                out[f"{name}_cutoff"] = pd.Series(chosen, index=out.index, dtype="float64")
            yield out

    return counts.mapInPandas(choose, T.StructType([counts.schema[stratum], *(T.StructField(f"{name}_cutoff", T.DoubleType()) for name in grid)]))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def judge(stats: DataFrame, chosen: DataFrame, stratum: str) -> DataFrame:
    """Adds base_failed, kept and failed_rules to rows with `stratum` and STATS.

    A stratum without cutoffs has only the base rules. The cutoffs are broadcast up to BROADCAST_STRATA
    strata and joined by a shuffle beyond.
    """
    chosen = durable(chosen)
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_STRATA else chosen
    failed = F.filter(F.array(*[F.when(value > F.col(f"{name}_cutoff"), name) for name, (value, _) in rules().items()]), F.isnotnull)
    joined = stats.join(side, stratum, "left").withColumns({"base_failed": base_failed(), "failed_rules": failed})
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(*[f"{name}_cutoff" for name in rules()])


def with_stratum(docs: DataFrame, column: str = "lang") -> DataFrame:
    return docs.withColumn("_stratum", F.coalesce(F.col(column).cast("string"), F.lit("")))


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, STATS, base_failed, failed_rules and kept of every row. Null texts have no words and fail; repeated rows repeat."""
    stats = durable(with_stats(with_stratum(docs, stratum), ["doc_id", "_stratum"]))
    return judge(stats, cutoffs(stats, labels, "_stratum"), "_stratum").drop("_stratum")


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; texts are never shuffled."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"))
    chosen = cutoffs(with_stats(whole, ["doc_id", "_stratum"]), labels, "_stratum")
    return judge(with_stats(whole, ["_stratum", "_row"]), chosen, "_stratum").filter("kept").select("_row.*")
