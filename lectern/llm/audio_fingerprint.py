"""Chroma audio fingerprints: integral-image filters over pitch-class frames, packed into 32-bit integers.

Recordings are columns of 8-bit PCM samples. Frames of samples become energies of twelve pitch classes;
sixteen rectangle filters, each a few look-ups in the integral image of the frames, give two bits apiece.
To align two recordings, equal integers vote for the difference of their places; the fullest bin of that
histogram is the offset, and the share of differing bits at it is the error. The integers of the queries are an inverted index
that every recording looks its own up in; all queries that align are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable, slices
from lectern.operators.blocks import SENT_BYTES, against_all

RATE, FRAME, HOP, SILENCE = 8_000, 256, 128, 128
CLASSES, SPAN = 12, 16
LOW_HZ, HIGH_HZ = 60.0, 3_500.0
#: Bits that may differ for two recordings to count as the same.
MOST_ERROR = 0.35
#: Query recordings of a block, where they are too many to be sent to every executor.
QUERY_BLOCK = 1_000
#: Samples that are turned into frames at once.
CHUNK_FRAMES = 8_192

_HZ = np.fft.rfftfreq(FRAME, 1 / RATE)
_USED = (_HZ >= LOW_HZ) & (_HZ <= HIGH_HZ)
_CLASS = np.zeros((len(_HZ), CLASSES), np.float32)
_CLASS[np.flatnonzero(_USED), np.round(CLASSES * np.log2(_HZ[_USED] / 440.0)).astype(int) % CLASSES] = 1
_WINDOW = np.hanning(FRAME).astype(np.float32)

#: (kind, first class, classes, frames): by time, by pitch, crosswise, and middle against both sides.
FILTERS = [(kind, first, high, wide) for (kind, wide), (first, high) in product((("time", 16), ("pitch", 8), ("cross", 16), ("middle", 12)), ((0, 4), (4, 4), (8, 4), (2, 8)))]
#: The two bits of a value are its place among these, in Gray code.
STEPS = np.array([-0.08, 0.0, 0.08], np.float32)
GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12 energies, each frame scaled to length 1 (a silent one stays 0). A recording shorter than a frame ends in silence."""
    if 0 < len(samples) < FRAME:
        samples = np.pad(samples, (0, FRAME - len(samples)), constant_values=SILENCE)
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    out = np.zeros((n, CLASSES), np.float32)
    for start in range(0, n, CHUNK_FRAMES):
        stop = min(n, start + CHUNK_FRAMES)
        cut = np.lib.stride_tricks.sliding_window_view(samples[start * HOP : (stop - 1) * HOP + FRAME], FRAME)[::HOP].astype(np.float32)
        cut = (cut - cut.mean(axis=1, keepdims=True)) * _WINDOW
        out[start:stop] = (np.abs(np.fft.rfft(cut, axis=1)) ** 2).astype(np.float32) @ _CLASS
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-6)


def packed(frames: np.ndarray) -> np.ndarray:
    """One unsigned integer for each window of SPAN frames; fewer frames are padded with silence to one window, none give none."""
    if not len(frames):
        return np.empty(0, np.uint32)
    if len(frames) < SPAN:
        frames = np.vstack([frames, np.zeros((SPAN - len(frames), CLASSES), np.float32)])
    image = np.zeros((len(frames) + 1, CLASSES + 1), np.float64)
    image[1:, 1:] = frames.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    at = np.arange(len(frames) - SPAN + 1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(len(at), np.uint32)
    for kind, c, high, wide in FILTERS:
        half, mid = wide // 2, c + high // 2
        if kind == "time":
            a, b = area(0, half, c, c + high), area(half, wide, c, c + high)
        elif kind == "pitch":
            a, b = area(0, wide, c, mid), area(0, wide, mid, c + high)
        elif kind == "cross":
            a = area(0, half, c, mid) + area(half, wide, mid, c + high)
            b = area(0, half, mid, c + high) + area(half, wide, c, mid)
        else:
            third = wide // 3
            a, b = 2 * area(third, 2 * third, c, c + high), area(0, third, c, c + high) + area(2 * third, wide, c, c + high)
        out = out << np.uint32(2) | GRAY[np.searchsorted(STEPS, np.log1p(a) - np.log1p(b))]
    return out


def fingerprint(recordings: DataFrame, key: str = "doc_id", samples: str = "samples") -> DataFrame:
    """key, n_frames and prints (array<bigint>, unsigned 32-bit) of every recording; map-only over whole recordings.

    A null or empty recording has no frames and no prints. Repeated rows repeat; an empty table gives an empty result.
    """
    rows = recordings.select(F.col(key).cast("bigint").alias("key"), F.col(samples).alias("samples"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [chroma(np.frombuffer(x or b"", np.uint8)) for x in part[1].to_pylist()]
            yield pa.RecordBatch.from_arrays([part[0], pa.array([len(f) for f in found], pa.int64()), pa.array([packed(f).astype(np.int64) for f in found], pa.list_(pa.int64()))], names=["key", "n_frames", "prints"])

    return rows.mapInArrow(run, "key bigint, n_frames bigint, prints array<bigint>")


class Index:
    """Inverted index over the integers of some query recordings: for each integer the recordings and places that hold it."""

    def __init__(self, wanted: pa.Table):
        self.name = wanted["query"].to_numpy()
        self.prints = [np.array(p, np.uint32) for p in wanted["prints"].to_pylist()]
        starts = [run_starts(p) for p in self.prints]
        owner = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
        place = np.concatenate([np.empty(0, np.int64), *starts])
        values = np.concatenate([np.empty(0, np.uint32), *(p[s] for p, s in zip(self.prints, starts, strict=True))])
        order = np.argsort(values, kind="stable")
        self.values, self.owner, self.place = values[order], owner[order], place[order]

    def aligned(self, prints: np.ndarray) -> list[dict]:
        """Of every query that shares an integer: votes, offset, wrong and compared bits at its fullest offset (of equal ones the smallest), where the error is small enough."""
        starts = run_starts(prints)
        low, high = (np.searchsorted(self.values, prints[starts], side) for side in ("left", "right"))
        held = np.empty((0, 3), np.int64)  # query, offset, votes
        for part in _parts(high - low):
            n = (high - low)[part]
            hit = np.repeat(low[part] - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
            fresh = np.stack([self.owner[hit], self.place[hit] - np.repeat(starts[part], n), np.ones(len(hit), np.int64)], axis=1)
            held = _counted(np.concatenate([held, fresh]))
        if not len(held):
            return []
        order = np.lexsort((held[:, 1], -held[:, 2], held[:, 0]))
        first = order[np.append(True, held[order][1:, 0] != held[order][:-1, 0])]
        out = []
        for w, shift, votes in held[first].tolist():
            a, b = prints[max(0, -shift) :], self.prints[w][max(0, shift) :]
            size = min(len(a), len(b))
            wrong = int(np.bitwise_count(a[:size] ^ b[:size]).sum())
            if wrong <= MOST_ERROR * 32 * size:
                out.append({"votes": votes, "query": int(self.name[w]), "offset": shift, "wrong": wrong, "compared": 32 * size})
        return out


def run_starts(prints: np.ndarray) -> np.ndarray:
    """Places where a run of one integer starts; a run votes once, so a steady tone is no crowd of votes."""
    return np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.empty(0, np.int64)


def _parts(sizes: np.ndarray, most: int = 4_000_000) -> Iterator[slice]:
    """Slices of rows that give at most so many hits together, or of one row."""
    ends, start, done = sizes.cumsum(), 0, 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield slice(start, stop)
        start, done = stop, int(ends[stop - 1])


def _counted(rows: np.ndarray) -> np.ndarray:
    """Votes added up by (query, offset)."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    new = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))) if len(rows) else np.empty(0, np.int64)
    return np.column_stack([rows[new, :2], np.add.reduceat(rows[:, 2], new)]) if len(new) else rows


LINK = pa.struct([(c, pa.int64()) for c in ("votes", "query", "offset", "wrong", "compared")])


def matches(prints: DataFrame, is_query, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """For every recording: key, class_id, n_frames, n_prints, n_links, queries, query, votes, offset, bit_error and same.

    prints is the result of `fingerprint`; `is_query` a condition on its `key`. Equal recordings are one class, named
    by its smallest key, and are searched once. A recording is linked with every query class of which it differs in at most
    MOST_ERROR of the bits, where most equal integers vote for the same offset; `queries` names each by its
    smallest query key, and query, votes, offset and bit_error are of the link with most votes (ties: fewer wrong bits, the smaller key).
    A recording is no link of its own, but a query that equals it is. Queries within `sent_bytes` are sent to where the
    recordings are; more meet them in blocks. Without links the list is empty, the match columns are null and `same` is false.
    """
    rows = durable(prints.select("key", "n_frames", "prints").withColumn("h", F.xxhash64("prints")))
    query_key = F.when(is_query, F.col("key"))
    classes = rows.filter(F.size("prints") > 0).groupBy("h", "prints").agg(F.min("key").alias("class_id"), F.min(query_key).alias("query"), F.countDistinct(query_key).alias("n_queries"))
    classes = durable(classes.withColumn("class", F.monotonically_increasing_id()))
    asked = classes.filter("query is not null").select("query", F.col("prints"))
    memo: dict = {}

    def search(held: pa.Table, wanted: pa.Table) -> pa.Table:
        if memo.get("of") is not wanted:
            memo.update(of=wanted, index=Index(wanted))
        found = [memo["index"].aligned(np.array(p, np.uint32)) for p in held["prints"].to_pylist()]
        kept = [k for k, links in enumerate(found) if links]
        return pa.table({"class": held["class"].take(pa.array(kept, pa.int64())), "links": pa.array([found[k] for k in kept], pa.list_(LINK))})

    kind = "class bigint, links array<struct<votes:bigint,query:bigint,offset:bigint,wrong:bigint,compared:bigint>>"
    found = against_all(classes.select("class", "prints"), "class", asked, "query", search, lambda t: t, kind, vector="prints", sent_bytes=sent_bytes, block=QUERY_BLOCK)
    linked = found.groupBy("class").agg(F.flatten(F.collect_list("links")).alias("links"))
    told = rows.join(classes, ["h", "prints"], "left").join(linked, "class", "left")
    # With its own class a recording is linked if another recording of it is a query.
    others = F.filter(F.coalesce("links", F.array().cast("array<struct<votes:bigint,query:bigint,offset:bigint,wrong:bigint,compared:bigint>>")), lambda x: ~x["query"].eqNullSafe(F.col("query")) | (F.col("n_queries") > 1) | ~F.col("key").eqNullSafe(F.col("query")))
    best = F.array_max(F.transform(others, lambda x: F.struct(x["votes"].alias("votes"), (-x["wrong"]).alias("right"), (-x["query"]).alias("minus"), x["offset"].alias("offset"), x["compared"].alias("compared"))))
    out = told.select("key", "class_id", "n_frames", F.size("prints").cast("bigint").alias("n_prints"), others.alias("others"), best.alias("b"))
    error = -F.col("b.right") / F.col("b.compared")
    return out.select("key", "class_id", "n_frames", "n_prints", F.size("others").cast("bigint").alias("n_links"), F.array_sort(F.transform("others", lambda x: x["query"])).alias("queries"), (-F.col("b.minus")).alias("query"), "b.votes", "b.offset", error.alias("bit_error"), F.col("b").isNotNull().alias("same"))
