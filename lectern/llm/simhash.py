"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints at most `max_bits` apart differ in at most that many of their eight bytes, so a linked pair
shares at least 8 - max_bits positional bytes: the guaranteed minimum. An index on single bytes would hold
a 256th of the corpus in each list and tally nearly all pairs. Here the tally is carried out by the keys:
the index is keyed by every choice of that minimum of byte positions together with the bytes found there,
so a list holds exactly the fingerprints whose tally with each other reaches the minimum, and a pair that
reaches it is in at least one list. Within a list pairs are verified by their differing bits. Nothing is
capped: a list gives a spanning forest of its verified links, not its pairs, which leaves every component as it is.

The pipeline links by the Jaccard similarity of sets, which 64 bits cannot bound: one shingle may turn any of them.
Its fingerprints are wider. The first bits of a shingle's hash deal it to one of so many places, and a place holds the
SimHash of its own shingles, eight bytes. So a shingle of one set alone changes one place only, and two sets that
d shingles tell apart agree in all places but d at most: the guaranteed minimum again. The index is keyed by places
with their bytes, the tally counts the places of two fingerprints that agree, and whole sets verify.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lectern.llm.common import durable, slices, small_batches
from lectern.llm.components import components

SEED = 42
BYTES = 8
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes that are turned into bits at once.
BLOCK = 65_536


def shingle_hashes(text: str, words_each: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; the whole sequence if it has fewer words; nothing without words."""
    words = text.encode().translate(LOWER).split()
    n = max(len(words) - words_each + 1, 1 if words else 0)
    joined = map(b" ".join, zip(*(words[k:] for k in range(min(words_each, len(words)))), strict=False))
    return np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit majority of the hashes; zero without any."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        block = hashes[start : start + BLOCK].astype(">u8").view(np.uint8).reshape(-1, BYTES)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id, row_key (a hash of the row's id and text) and fp of every row; map-only.

    Null texts are empty. Only doc_id and text are read, so other columns may have any name.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [fingerprint(shingle_hashes(x or "", words_each)) for x in part[2].to_pylist()]
            yield pa.RecordBatch.from_arrays([part[0], part[1], pa.array(found, pa.int64())], names=["doc_id", "row_key", "fp"])

    return rows.mapInArrow(run, "doc_id bigint, row_key bigint, fp bigint")


def forest(members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(child, root): places of members, an array of rows of unsigned words, that chains of verified pairs connect.

    Breadth first: each reached member is compared with those not yet reached, all at once, so a dense
    list costs little more than its length.
    """
    left = np.lexsort(members.T[::-1])
    child, root = [], []
    while len(left) > 1:
        start, left = left[0], left[1:]
        queue = [start]
        while queue and len(left):
            apart = np.bitwise_count(members[left] ^ members[queue.pop()]).sum(axis=1, dtype=np.int64)
            near = apart <= max_bits
            reached, left = left[near], left[~near]
            queue.extend(reached)
            child.append(reached)
            root.append(np.full(len(reached), start))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *child]).astype(np.int64), np.concatenate([empty, *root]).astype(np.int64)


def each_list(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each list, whole, from batches that are sorted by its keys; one list is held at a time."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def whole_lists(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Many lists at a time, all whole, from batches that are sorted by `key`, and where each row's list ends."""
    def ready(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        keys = rows[key].to_numpy()
        starts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
        return rows, np.repeat(starts[1:], np.diff(starts))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy()
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if last or held and held[-1][key][0].as_py() != keys[0]:
            rows = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
            if rows:
                yield ready(rows[0])
            held = []
        held.append(batch.slice(last))
    if held:
        yield ready(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links between the distinct fingerprints `fp` that connect all pairs at most `max_bits` bits apart.

    Lists of one member are dropped by counts that are aggregated before the shuffle; what is left is
    sorted by list and streamed, one list in memory at a time as 8 bytes for each distinct fingerprint.
    The size of `postings` is told before the explode, many times too low, so the join is never left to that figure.
    """
    shared = BYTES - max_bits
    if not 0 < shared <= BYTES:
        raise ValueError(f"max_bits must be from 0 to {BYTES - 1}")
    masks = [sum(0xFF << 8 * p for p in places) for places in combinations(range(BYTES), shared)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("places", "bytes"))
    full = postings.groupBy("places", "bytes").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    lists = postings.join(full.hint("merge"), ["places", "bytes"]).repartition("places", "bytes").sortWithinPartitions("places", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in each_list(batches, ["places", "bytes"]):
            fp = one["fp"].to_numpy(zero_copy_only=False)
            child, root = forest(fp.view(np.uint64).reshape(-1, 1), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root])], names=["a", "b"])

    return lists.select("places", "bytes", "fp").mapInArrow(run, "a bigint, b bigint")


def _rooted(found: DataFrame, max_bits: int) -> DataFrame:
    """fp and root of every distinct fingerprint."""
    nodes = found.select("fp").distinct()
    roots = components(links(nodes, max_bits)).select(F.col("node").alias("fp"), "root")
    return nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, words_each: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every row; component_id is the smallest doc_id that links can reach.

    Rows with equal fingerprints are one node, so copies are never paired; repeated rows get equal answers.
    Rows without words have fingerprint zero and are linked like any other. A null doc_id names no
    component: one of null ids alone has a null component_id. An empty table gives an empty result.
    """
    found = durable(fingerprints(docs, words_each))
    per_fp = found.groupBy("fp").agg(F.min("doc_id").alias("least")).join(_rooted(found, max_bits), "fp")
    per_root = per_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    named = per_fp.join(per_root, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


# Wide fingerprints and exact similarity of shingle sets, for the pipeline.

#: Sets are near-duplicates from this Jaccard similarity (numerator, denominator) on.
ALIKE = (4, 5)
#: Places of the shortest wide fingerprints; a power of two.
LEAST_PLACES = 64
#: Bytes of fingerprints that are compared at once.
TALLY_BYTES = 1 << 20
#: About so many rows tell which lists are common, and so many common ones at most are sent to every task. Both only set the order of lists.
SAMPLE_ROWS, COMMON = 5_000, 300_000
#: Row keys that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bits of the bitmaps that spare rows a shuffle, as a power of two: 16 MB each, whatever the input.
MARK_BITS = 27
#: Bits that one row of a bitmap holds, as a power of two; fixed by bitmap_construct_agg.
ROW_BITS = 15
#: Members of a list that are held against each other at once; longer lists are cut into squares of so many by so many.
LIST_ROWS = 4_096
#: Members up to which a list gives its likely pairs as rows: at most half as many as this for each member.
SHORT_LIST = 256


def n_places(n: int) -> int:
    """Places that sets of n shingles are dealt to: as many as shingles, rounded down to a power of two."""
    return max(LEAST_PLACES, 1 << max(0, n.bit_length() - 1))


def widths(n: int) -> list[int]:
    """Numbers of places in which a set of n shingles is looked for: its own, and that of smaller sets it can be alike to.

    Two sets meet in the places of the smaller one.
    """
    return sorted({n_places(n), n_places(-(-n * ALIKE[0] // ALIKE[1]))}, reverse=True)


def most_apart(n: int, size: int) -> int:
    """How many shingles at most tell a set of n from one alike that it meets in `size` places; always fewer than places."""
    other = n * ALIKE[1] // ALIKE[0] if size == n_places(n) else 2 * size - 1
    return (ALIKE[1] - ALIKE[0]) * (n + other) // (ALIKE[1] + ALIKE[0])


def wide_fingerprint(own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit majority of the hashes in each of `size` places (a power of two), and how many those are.

    `own` is sorted and distinct, and its first bits are the places; an empty place has its number in those bits, else zeros.
    """
    shift = np.uint64(64 - (size.bit_length() - 1))
    major, times = np.arange(size, dtype=np.uint64) << shift, np.zeros(size, np.int64)
    place = (own >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    place, many = place[first], np.diff(np.append(first, len(own)))
    times[place] = many
    major[place] = own[first] & own[first + many - 1]  # the majority of one hash or two
    crowded = np.flatnonzero(many > 2)
    for start in range(0, len(crowded), BLOCK):
        at = crowded[start : start + BLOCK]
        cut = many[at].cumsum() - many[at]
        rows = np.repeat(first[at] - cut, many[at]) + np.arange(many[at].sum())
        bits = np.unpackbits(own[rows].astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1)
        ones = np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
        major[place[at]] = np.packbits(2 * ones > many[at, None], axis=1).view(">u8").reshape(-1)
    return major, times


def list_keys(major: np.ndarray) -> np.ndarray:
    """A hash of each place and its bytes; fingerprints of different widths have lists of their own."""
    x = major ^ np.uint64(len(major) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def lists_of(major: np.ndarray, times: np.ndarray, n: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The lists that a set of n shingles is in, for the fingerprint of one width.

    Two alike fingerprints of d = `most_apart` agree in all places but d at most. In an order that all share (rare
    lists first, those of empty places last) the first list they have in common comes after at most d others in
    either, so the first d + 1 of each suffice to meet.
    """
    keys, (known, n_known) = list_keys(major), common
    seen = np.zeros(len(keys), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        seen = np.where(known[at] == keys, n_known[at], 0)
    return keys[np.lexsort((keys, seen, times == 0))[: most_apart(n, len(major)) + 1]]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted, distinct) reach ALIKE."""
    most, least = max(len(a), len(b)), min(len(a), len(b))
    if ALIKE[1] * least < ALIKE[0] * most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return ALIKE[1] * both >= ALIKE[0] * (len(a) + len(b) - both)


def tally_bytes(major: np.ndarray) -> bytes:
    """What the tally is taken from: the last four bits of each place."""
    last = major.astype(np.uint8)
    return (last[::2] & 15 | last[1::2] << 4).tobytes()


def own_places(fp: bytes) -> int:
    """Places of the first of the fingerprints that `fp` holds the `tally_bytes` of: one, or one and another of half as many places."""
    return 2 * len(fp) if len(fp).bit_count() == 1 else 4 * len(fp) // 3


def in_places(fp: bytes, size: int) -> np.ndarray:
    """The `tally_bytes` of the fingerprint of `size` places."""
    own = own_places(fp)
    return np.frombuffer(fp, np.uint8, size // 2, 0 if own == size else own // 2)


def enough_agree(apart: np.ndarray, n: np.ndarray, other_n: np.ndarray) -> np.ndarray:
    """The count filter: whether so few places differ (`apart`) that two sets of these sizes may reach ALIKE.

    A shingle of one set alone changes one place, so as many shingles differ as places do at least;
    of two sets with the similarity x / y, (y - x) / (y + x) of both sizes' sum differ at most.
    """
    return apart * (ALIKE[1] + ALIKE[0]) <= (ALIKE[1] - ALIKE[0]) * (n + other_n)


def may_be_alike(n: int, fp: bytes, other_n: int, other_fp: bytes) -> bool:
    """False only if two sets, by sizes and fingerprints, cannot reach ALIKE."""
    if ALIKE[1] * min(n, other_n) < ALIKE[0] * max(n, other_n):
        return False
    size = n_places(min(n, other_n))
    return bool(enough_agree(differing(in_places(fp, size), in_places(other_fp, size)), n, other_n))


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many halves of bytes differ along the last axis."""
    both = a ^ b
    return np.count_nonzero(both & 15, axis=-1) + np.count_nonzero(both & 240, axis=-1)


def places_apart(wide: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many places differ between rows i and j of fingerprints of one width."""
    step = max(1, TALLY_BYTES // wide.shape[1])
    return np.concatenate([np.empty(0, np.int64), *(differing(wide[i[c : c + step]], wide[j[c : c + step]]) for c in range(0, len(i), step))])


def possible(n: np.ndarray, fp: list[bytes], root: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, the others of another root (and side, if given) that `may_be_alike` does not rule out; each pair once."""
    own = np.array([own_places(x) for x in fp])
    two = np.array([len(x) for x in fp]) > own // 2
    for size in np.unique(own).tolist():
        among = np.flatnonzero((own == size) | ((own == 2 * size) & two))
        wide = np.stack([in_places(fp[k], size) for k in among])
        own_n, own_root = n[among], root[among]
        for i in np.flatnonzero(own[among] == size).tolist():
            fits = (own_root != own_root[i]) & (ALIKE[1] * np.minimum(own_n, own_n[i]) >= ALIKE[0] * np.maximum(own_n, own_n[i]))
            fits &= (own[among] > size) | (among > among[i])
            if side is not None:
                fits &= side[among] != side[among[i]]
            j = np.flatnonzero(fits)
            near = j[enough_agree(places_apart(wide, np.full(len(j), i), j), own_n[j], own_n[i])]
            if len(near):
                yield int(among[i]), among[near]


def pairs_within(ends: np.ndarray, n: np.ndarray, fp: list[bytes], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one list and of different roots that `may_be_alike` does not rule out, for many short lists at once."""
    row = np.arange(len(ends))
    each = ends - 1 - row
    i = np.repeat(row, each)
    j = i + 1 + np.arange(len(i)) - np.repeat(each.cumsum() - each, each)
    fits = (root[i] != root[j]) & (ALIKE[1] * np.minimum(n[i], n[j]) >= ALIKE[0] * np.maximum(n[i], n[j]))
    i, j = i[fits], j[fits]
    own = np.array([own_places(x) for x in fp], np.int64)
    near = np.zeros(len(i), bool)
    size_of, row_of = np.minimum(own[i], own[j]), np.zeros(len(ends), np.int64)
    for size in np.unique(size_of).tolist():
        pick = np.flatnonzero(size_of == size)
        used = np.unique(np.concatenate([i[pick], j[pick]]))
        wide = np.stack([in_places(fp[k], size) for k in used])
        row_of[used] = np.arange(len(used))
        near[pick] = enough_agree(places_apart(wide, row_of[i[pick]], row_of[j[pick]]), n[i[pick]], n[j[pick]])
    return i[near], j[near]


def marks(keys: DataFrame, column: str) -> Broadcast:
    """A bitmap of 2 ** MARK_BITS bits, sent to every executor, in which the first bits of each 64-bit hash in a column are set.

    A hash whose bit is not set is not in `keys`. Others may be in it, so they still need a join: the fuller
    the bitmap, the more rows go through that join, and no result depends on it.
    """
    bit = F.shiftrightunsigned(column, 64 - MARK_BITS)
    spots = keys.select(F.shiftrightunsigned(bit, ROW_BITS).alias("row"), bit.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("spot"))
    rows = spots.repartition("row").groupBy("row").agg(F.bitmap_construct_agg("spot").alias("bits")).toArrow()
    held = np.zeros((1 << (MARK_BITS - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
    for row, bits in zip(rows["row"].to_pylist(), rows["bits"], strict=True):
        held[row] = np.frombuffer(bits.as_buffer(), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(held.reshape(-1))


def set_in(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = (hashes.view(np.uint64) >> np.uint64(64 - MARK_BITS)).astype(np.int64)
    return (held[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def marked(sent: Broadcast, column: str) -> Column:
    """Whether a hash's bit is set."""

    @F.pandas_udf("boolean")
    def hit(hashes: pd.Series) -> pd.Series:
        return pd.Series(set_in(sent.value, hashes.to_numpy(np.int64)))

    return hit(column)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), "text")


def common_lists(docs: DataFrame, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """Common lists, sorted, and how often a sample of rows has each."""
    sample = _keyed(docs).filter(F.pmod("row_key", F.lit(max(1, docs.count() // SAMPLE_ROWS))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(shingle_hashes(x or "", words_each)) for x in part[2].to_pylist()]
            keys = [list_keys(wide_fingerprint(own, size)[0]) for own in sets for size in widths(len(own))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64))], names=["list"])

    counts = sample.mapInArrow(run, "list bigint").groupBy("list").agg(F.count("*").alias("n")).filter("n > 1")
    rows = counts.orderBy(F.desc("n"), "list").limit(COMMON).toArrow()
    known, n = rows["list"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int64)
    order = np.argsort(known)
    return known[order], n[order]


def indexed(docs: DataFrame, words_each: int) -> DataFrame:
    """doc_id, row_key, node (a hash of the row's set), its size n, fp (the `tally_bytes` of its fingerprints) and its lists; map-only. Null texts are empty."""
    sent = docs.sparkSession.sparkContext.broadcast(common_lists(docs, words_each))

    def entry(own: np.ndarray) -> tuple[bytes, np.ndarray]:
        wide = [wide_fingerprint(own, size) for size in widths(len(own))]
        lists = [lists_of(major, times, len(own), sent.value) for major, times in wide] if len(own) else [np.empty(0, np.uint64)]
        return b"".join(tally_bytes(major) for major, _ in wide), np.concatenate(lists).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(shingle_hashes(x or "", words_each)) for x in part[2].to_pylist()]
            node = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            fp, lists = zip(*map(entry, sets), strict=True)
            yield pa.RecordBatch.from_arrays([part[0], part[1], pa.array(node), pa.array([len(x) for x in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "row_key", "node", "n", "fp", "lists"])

    return _keyed(docs).mapInArrow(run, "doc_id bigint, row_key bigint, node bigint, n bigint, fp binary, lists array<bigint>")


def postings(listed: DataFrame, again: Broadcast, full: Broadcast | None = None) -> DataFrame:
    """(node, list) for the lists of `listed` (node, lists, alone) that may be in `full`, if given.

    Rows with `alone` whose node may be in `again` are left out, in the same pass, so that a task has one Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2_048):
            node = part["node"].to_numpy()
            part = part.filter(pa.array(~(part["alone"].to_numpy(zero_copy_only=False) & set_in(again.value, node))))
            lists = part["lists"].flatten().to_numpy()
            node = np.repeat(part["node"].to_numpy(), pc.list_value_length(part["lists"]).to_numpy())
            keep = set_in(full.value, lists) if full else slice(None)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(lists[keep])], names=["node", "list"])

    return listed.select("node", "lists", "alone").mapInArrow(run, "node bigint, list bigint")


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node and text, once each, for `rows` (row_key, node); checkpointed."""
    rows = durable(rows)
    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    return durable(_keyed(docs).join(rows, "row_key").dropDuplicates(["row_key"]).select("node", F.coalesce("text", F.lit("")).alias("text")))


def exact_forest(sets: list[np.ndarray], n: np.ndarray, fp: list[bytes], root: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between places of sets that, with the roots they have already, connect all pairs (of two sides, if given) that reach ALIKE."""
    root, found = root.copy(), []
    for i, others in possible(n, fp, root.copy(), side):
        for j in others.tolist():
            if root[i] != root[j] and alike(sets[i], sets[j]):
                found.append((i, j))
                root[root == root[j]] = root[i]
    return found


def exact_links(nodes: DataFrame, listed: DataFrame, again: Broadcast, docs: DataFrame, words_each: int) -> DataFrame:
    """(a, b): links that connect all pairs of nodes (node, row_key, n, fp) whose sets reach ALIKE, and no others.

    `listed` and `again` give their lists, see `postings`.

    Such a pair's fingerprints agree in a place whose list both are in (`lists_of`). Each member of a list
    is first held against the list's least one. Lists whose members those links leave in several components
    are then compared whole. Short ones give the pairs that the count filter lets through, and each is verified
    once however many lists it is in. Longer ones are compared in squares of at most LIST_ROWS by LIST_ROWS
    members, one in memory at a time, so that a long list is the work of many tasks and its pairs are not emitted.
    """
    counts = postings(listed, again).groupBy("list").agg(F.count("*").alias("n"))
    # The postings but for those of lists that surely have one member.
    posted = durable(postings(listed, again, marks(counts.filter("n > 1"), "list")))
    # Lists of one member are dropped, and of lists with equal members one stays: told by two 64-bit sums, so that no list is gathered.
    sums = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"sum{k}") for k in range(2)]
    several = posted.groupBy("list").agg(F.min("node").alias("least"), F.count("*").alias("n"), *sums).filter("n > 1")
    once = durable(several.groupBy("least", "n", "sum0", "sum1").agg(F.min("list").alias("list")).select("list", "least"))
    members = durable(posted.join(F.broadcast(once) if once.count() <= BROADCAST_ROWS else once, "list").select("list", "least", "node"))
    keys = nodes.select("row_key", "node")
    pairs = members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    end = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("fp").alias(f"fp_{name}"))
    text = lambda of, name: of.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))

    def unlike_left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [may_be_alike(*x) for x in zip(*(batch[k].to_pylist() for k in range(2, 6)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            near = [alike(*(np.unique(shingle_hashes(t, words_each)) for t in both)) for both in zip(part[2].to_pylist(), part[3].to_pylist(), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    sized = pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", "n_a", "fp_a", "n_b", "fp_b")

    def verified(likely: DataFrame) -> DataFrame:
        ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = texts_of(docs, keys.join(ends, "node", "left_semi").select("row_key", "node"))
        read = likely.join(text(texts, "a"), "a").join(text(texts, "b"), "b").select("a", "b", "text_a", "text_b")
        return durable(read.mapInArrow(compare, "a bigint, b bigint"))

    first = verified(durable(sized.mapInArrow(unlike_left_out, "a bigint, b bigint")))

    named = members.join(components(first), "node", "left").select("list", "node", F.coalesce("root", "node").alias("root"))
    apart = named.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("list")
    left = durable(named.join(apart, "list", "left_semi"))
    counted = left.groupBy("list").agg(F.count("*").alias("size"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_lists(batches, "list"):
            node = rows["node"].to_numpy()
            i, j = pairs_within(ends, rows["n"].to_numpy(), rows["fp"].to_pylist(), rows["root"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    short = left.join(counted.filter(F.col("size") <= SHORT_LIST).select("list"), "list", "left_semi").join(nodes.select("node", "n", "fp"), "node")
    short = short.repartition("list").sortWithinPartitions("list").select("list", "node", "root", "n", "fp")
    second = verified(durable(short.mapInArrow(within, "a bigint, b bigint").distinct()))

    cuts = counted.filter(F.col("size") > SHORT_LIST).select("list", F.ceil(F.col("size") / LIST_ROWS).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("node", "list"), "cuts").cast("int")
    squares = left.join(cuts, "list").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    squares = squares.select("list", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root")
    square = ["list", "low", "high"]

    def side(one: pa.RecordBatch) -> np.ndarray | None:
        return one["own"].to_numpy() if one["low"][0] != one["high"][0] else None

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of each square that may be like one of another component."""
        for one in each_list(batches, square):
            keep = np.zeros(one.num_rows, bool)
            for i, others in possible(one["n"].to_numpy(), one["fp"].to_pylist(), one["root"].to_numpy(), side(one)):
                keep[i], keep[others] = True, True
            yield one.filter(pa.array(keep))

    sized_rows = squares.join(nodes.select("node", "n", "fp"), "node").select(*square, "own", "node", "root", "n", "fp")
    kind = "list bigint, low int, high int, own int, node bigint, root bigint, n bigint, fp binary"
    open_lists = durable(sized_rows.repartition(*square).sortWithinPartitions(*square, "root", "node").mapInArrow(partners, kind))
    more = texts_of(docs, keys.join(open_lists.select("node").distinct(), "node", "left_semi").select("row_key", "node"))
    whole = open_lists.join(more, "node").repartition(*square).sortWithinPartitions(*square, "root", "node").select(*square, "own", "node", "root", "n", "fp", "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in each_list(batches, square):
            node = one["node"].to_numpy()
            sets = [np.unique(shingle_hashes(t, words_each)) for t in one["text"].to_pylist()]
            found = exact_forest(sets, one["n"].to_numpy(), one["fp"].to_pylist(), one["root"].to_numpy(), side(one))
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return first.unionByName(second).unionByName(whole.mapInArrow(search, "a bigint, b bigint")).distinct()


def _kept(docs: DataFrame, words_each: int) -> tuple[DataFrame, Broadcast]:
    """_kept_id and _kept_key of the rows that stay, and a bitmap of the keys that are repeated or may go."""
    found = durable(indexed(docs, words_each))
    again = marks(found.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "node")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    alone = found.filter(~marked(again, "node")).select("node", own.alias("first"), "n", "fp")
    grouped = durable(found.filter(marked(again, "node")).groupBy("node").agg(F.min(own).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("lists").alias("lists")))
    per_node = durable(alone.unionByName(grouped.drop("lists")))
    listed = found.select("node", "lists", F.lit(True).alias("alone")).unionByName(grouped.select("node", "lists", F.lit(False).alias("alone")))
    roots = components(exact_links(per_node.select("node", F.col("first.row_key").alias("row_key"), "n", "fp"), listed, again, docs, words_each))
    kept = per_node.select("node", "first").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = durable(kept.select(F.coalesce("first.doc_id", F.lit(0)).alias("_kept_id"), F.col("first.row_key").alias("_kept_key")))
    times = found.groupBy("row_key").agg(F.count("*").alias("n")).join(kept.select(F.col("_kept_key").alias("row_key"), F.lit(True).alias("stays")).distinct(), "row_key", "left")
    return kept, marks(times.filter("n > 1 or stays is null"), "row_key")


def keep_one(docs: DataFrame, words_each: int = 5) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the row with the smallest doc_id stays (null ids last).

    Components are those of all pairs whose sets of shingles reach the Jaccard similarity ALIKE. Of rows that
    repeat in both id and text one stays. All columns of `docs` are returned; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        kept, unsure = _kept(docs, words_each)
    # Rows that are kept and not repeated need no join; the others, and those that share a bit with them, do.
    doubtful = marked(unsure, "_kept_key")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_kept_id"), F.xxhash64("doc_id", "text").alias("_kept_key"))
    joined = rows.filter(doubtful).join(kept, ["_kept_id", "_kept_key"], "left_semi").dropDuplicates(["_kept_id", "_kept_key"])
    return rows.filter(~doubtful).unionByName(joined.select(*rows.columns)).select("_row.*")
