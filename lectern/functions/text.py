"""Text expressions: sentences, words, tokens, shingles. All are Columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z(\"'])"

#: Words that say nothing about what a question asks.
STOP_WORDS = (
    "what which when where how does should would could with from that this than into "
    "about after before between most best first more less their there these those "
    "patient patients clinician eyes"
).split()


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Trimmed sentences that are not empty; a null text has none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK, -1), trim)
    return F.filter(parts, lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def plain_words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, the words that shingles and question checks use."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(text: Column, size: int = 5) -> Column:
    """The set of runs of `size` words; a shorter text is one shingle, an empty one the empty shingle."""
    words = plain_words(text)
    last = F.greatest(F.size(words) - size, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, size), " ")))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements as a share of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def content(text: Column) -> Column:
    """Words of four characters or more that are no stop-words, each once."""
    return F.array_distinct(F.filter(plain_words(text), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP_WORDS)))


def joined_words(text: Column) -> Column:
    return F.array_join(plain_words(text), " ")


def normalise(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def node_text(text: Column) -> Column:
    """White space collapsed, none before closing punctuation."""
    return F.regexp_replace(trim(F.regexp_replace(text, r"\s+", " ")), r"\s+([.,;:)])", "$1")
