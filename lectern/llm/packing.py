"""Best-fit packing of tokenised documents into fixed-length training sequences.

Two narrow steps. `token_pieces` is map-only: it encodes whole texts, appends the end id, and cuts only
what is longer than a sequence. `pack_pieces` shuffles the pieces' small metadata (never texts) and runs,
in every partition, a bounded-space online best fit: a fixed number of open bins, found through a bitset
keyed by free space; when another bin is needed beyond that number, the fullest closes first.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices

SEQUENCE_TOKENS = 2048
OPEN_BINS = 16_384
#: Pieces that arrive together; the longest of them are placed first.
ARRIVALS = 16_384
END_ID = 0
#: Encoded words that a Python worker remembers; a full memory is emptied, which changes no result.
WORD_MEMORY = 400_000


class ByteBpe:
    """Ids of a byte-level BPE file, with a memory of encoded words.

    A text is cut before every single space that a non-space follows: the pre-tokeniser always starts a
    token there, so the parts' ids joined are the text's ids. Texts with longer runs of white space, or
    with a special token's string, are encoded whole. Very long runs of white space, which the
    pre-tokeniser's look-ahead cannot pass, are cut out first: all of a run but its last character is one
    pre-token, or all of it where a text or a special token's string follows none.
    """

    SPECIAL = "<|endoftext|>"
    UNSAFE = re.compile(r" (?:\s|\Z)|<\|endoftext\|>")
    #: The white space of the pre-tokeniser, in runs too long for its look-ahead.
    LONG_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")

    def __init__(self, json_path: str):
        import tiktoken

        ranks_path = re.sub(r"\.json$", ".tiktoken", json_path)
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        special = {self.SPECIAL: len(ranks)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.single = tiktoken.Encoding("byte_bpe_single", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens=special)
        self.memory: dict[str, bytes] = {}

    def pretoken(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        return self.single.encode_ordinary(text)

    def _encode(self, text: str) -> bytes:
        ids: list[int] = []
        start = 0
        for gap in self.LONG_GAP.finditer(text):
            ids += self.encoding.encode(text[start : gap.start()], allowed_special="all")
            start = gap.end() if gap.end() == len(text) or text.startswith(self.SPECIAL, gap.end()) else gap.end() - 1
            ids += self.pretoken(text[gap.start() : start])
        return np.array(ids + self.encoding.encode(text[start:], allowed_special="all"), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.UNSAFE.search(text):
            return self._encode(text)
        parts = text.split(" ")
        head = self._encode(parts[0]) if parts[0] else b""
        memory = self.memory
        out = []
        for word in parts[1:]:
            ids = memory.get(word)
            if ids is None:
                if len(memory) >= WORD_MEMORY:
                    memory.clear()
                ids = memory[word] = self._encode(" " + word)
            out.append(ids)
        return head + b"".join(out)


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    A null or empty text is one piece of the end id alone. A document longer than `capacity` is cut into
    pieces of `capacity` ids, of which the first takes what is left over. Repeated rows give repeated
    pieces; a null doc_id stays null. Only doc_id and text are read, so other columns may have any name.
    """
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(tokenizer), np.array([END_ID], dtype="<u4").tobytes()
        for rows in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
                ids = memoryview(bpe.encode(text or "") + end)
                total = len(ids) // 4
                start, piece = 0, 0
                stop = total % capacity or min(total, capacity)
                while start < total:
                    part = ids[4 * start : 4 * stop]
                    out.append((doc_id, piece, start, stop - start, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if with_ids else [])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names=names[: len(columns)])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(cut, schema)


class BestFit:
    """Places lengths into bins of `capacity`; at most `open_bins` stay open.

    `free` has bit f set while an open bin has f places left, so the fullest bin that still fits a length
    is the lowest set bit at or above it, and the fullest bin of all is the lowest set bit.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            self.free &= ~(1 << free)
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            bin_id, free = self.made, self.capacity
            self.made += 1
            self.open += 1
            if self.open > self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
        left = free - length
        if left:
            self.by_free[left].append(bin_id)
            self.free |= 1 << left
        else:
            self.open -= 1
        return bin_id, self.capacity - free


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, arrivals: int = ARRIVALS) -> DataFrame:
    """Adds sequence_id and offset to pieces no longer than `capacity`; each sequence is gapless from 0.

    Pieces are dealt by a hash of themselves, so no key can be hot, and adaptive execution joins small
    partitions; they arrive in groups of `arrivals` in the order of that hash, the longest of a group first,
    so a repeated task makes the same sequences.
    A sequence never spans partitions; what is left open at a partition's end is a few bins for each.
    Ties and repeated rows are placed one after another. An empty input gives an empty result.
    """
    spot = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    dealt = pieces.withColumn("_spot", spot).repartition("_spot").sortWithinPartitions("_spot", "doc_id", "piece", "length").drop("_spot")
    names = pieces.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 36

        def placed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            rows = rows.take(pa.array(np.argsort(-rows["length"].to_numpy(), kind="stable")))
            places = [bins.place(length) for length in rows["length"].to_pylist()]
            sequence = pa.array([base + b for b, _ in places], pa.int64())
            offset = pa.array([o for _, o in places], pa.int64())
            return pa.RecordBatch.from_arrays([*rows.columns, sequence, offset], names=[*names, "sequence_id", "offset"])

        held, n = [], 0
        for batch in batches:
            for rows in slices([batch], arrivals):
                if n + rows.num_rows > arrivals:
                    cut = arrivals - n
                    yield placed([*held, rows.slice(0, cut)])
                    held, n, rows = [], 0, rows.slice(cut)
                held.append(rows)
                n += rows.num_rows
        if n:
            yield placed(held)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(pack, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """Whole documents into sequences: `token_pieces`, then `pack_pieces`."""
    return pack_pieces(token_pieces(docs, tokenizer, capacity, with_ids), capacity, open_bins)
