"""Stand-ins for models: an embedder, a scorer and logits that need no weights. Each is array in, array out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import plain_words

DIMENSIONS = 64
Embed = Callable[[list[str]], np.ndarray]


def hash_embed(texts: list[str], kind: type = np.float32) -> np.ndarray:
    """Unit vectors of hashed words; the first axis for texts without words."""
    out = np.zeros((len(texts), DIMENSIONS), kind)
    for row, text in zip(out, texts, strict=True):
        for word in (text or "").lower().split():
            h = crc32(word.encode())
            row[h % DIMENSIONS] += 1 if h & 1024 else -1
        if not row.any():
            row[0] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def hash_embed_doubles(texts: list[str]) -> np.ndarray:
    """The same in doubles, where a similarity is held against a limit that it may equal."""
    return hash_embed(texts, np.float64)


def embedder(embed: Embed = hash_embed, kind: str = "array<float>"):
    """A vectorised function text -> array<float>, or of another `kind`; the plug-in comes to each worker once."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embed(texts.fillna("").tolist())), index=texts.index)

    return run


def overlap_logit(query: Column, passage: Column) -> Column:
    """A stand-in reranker: how many words of the query the passage holds, against half of them."""
    q = F.array_distinct(plain_words(query))
    held = F.size(F.array_intersect(q, plain_words(passage)))
    return (2 * held - F.size(q)).cast("double") / 4
