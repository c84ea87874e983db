"""Vectors of whole numbers and their exact scores, for the searches of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.operators.blocks import matrix

#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)


def usable(vector: str) -> Column:
    """Whether a vector is there and each of its components is a finite number."""
    value = lambda x: x.cast("double")
    odd = lambda x: x.isNull() | F.isnan(value(x)) | (F.abs(value(x)) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, odd)


def whole(vectors: pa.ChunkedArray | pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component as int64; shorter vectors end in zeros, and components are held within 2 ** 62."""
    return np.floor(matrix(vectors) * scale).clip(-(2.0**62), 2.0**62).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, exact as long as they fit in 64 bits."""
    most = lambda x: float(np.abs(x).max(initial=0))
    if most(a) * most(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def first_k(found: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed values of each column; of equal values the upper rows come first."""
    n = len(found)
    if not n or not found.shape[1]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if float(np.abs(found).max()) * n < 2.0**61:
        place = found * n + (n - 1 - np.arange(n))[:, None]  # one number for value and row
        place = np.where(allowed, place, np.iinfo(np.int64).min)
        top = np.argpartition(place, max(0, n - k), axis=0)[max(0, n - k) :]
    else:
        top = np.lexsort((-found, ~allowed), axis=0)[:k]
    column = np.broadcast_to(np.arange(found.shape[1]), top.shape)
    keep = allowed[top, column]
    return top[keep], column[keep]
