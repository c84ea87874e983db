"""Edit-aware token counts: segment trees over the pre-tokens of each document.

The leaves of a tree are blocks of pre-tokens with their lengths and token counts; inner nodes hold sums.
A pre-tokeniser reads left to right and looks at most two characters ahead, so an edit can change nothing
before the block that ends ahead of it, and nothing after the first old block boundary, behind the edit,
that is again a boundary. Only that region is cut and encoded anew; then the sums above it are updated.
An empty table gives an empty result; a text may be of any length, white space alone included.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import slices
from lectern.llm.packing import ByteBpe

BLOCK = 32
#: A leaf that edits have grown beyond this many characters a pre-token is split again by a rebuild.
GROWN = 16 * BLOCK
MEMORY = 400_000
PRETOKEN = regex.compile(public_tokenizers.PATTERN)


class Counter:
    """Tokens of single pre-tokens, remembered."""

    def __init__(self, path: str):
        self.bpe, self.memory = ByteBpe(path), {}

    def __call__(self, pretoken: str) -> int:
        n = self.memory.get(pretoken)
        if n is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            n = self.memory[pretoken] = len(self.bpe.pretoken(pretoken))
        return n


@cache
def counter(path: str) -> Counter:
    return Counter(path)


class CountTree:
    """Leaf blocks (characters, tokens) under a complete binary tree of sums."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.width = 1
        while self.width < max(1, len(leaves)):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (c, t) in enumerate(leaves, self.width):
            self.chars[i], self.tokens[i] = c, t
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def leaves(self) -> list[tuple[int, int]]:
        return [(c, t) for c, t in zip(self.chars[self.width :], self.tokens[self.width :], strict=True) if c]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a place; the last one for the end."""
        i, start = 1, 0
        place = min(place, max(self.chars[1] - 1, 0))
        while i < self.width:
            i *= 2
            if place >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.width
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._sum(i)


def blocks(text: str, count: Counter) -> list[tuple[int, int]]:
    parts = PRETOKEN.findall(text)
    return [(sum(map(len, b)), sum(map(count, b))) for b in (parts[k : k + BLOCK] for k in range(0, len(parts), BLOCK))]


def edit(text: str, tree: CountTree, start: int, end: int, put: str, count: Counter) -> tuple[str, CountTree, int]:
    """The edited text, its tree, and how many pre-tokens were encoded anew. Places beyond the text mean its end."""
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    new = text[:start] + put + text[end:]
    if not text or not new:
        found = blocks(new, count)
        return new, CountTree(found), sum(1 for _ in PRETOKEN.finditer(new))
    first, begin = tree.find(max(0, start - 3))  # what ends here could depend on the edit
    last, last_begin = tree.find(end)
    shift, stop = len(put) - (end - start), last_begin + tree.chars[last + tree.width]
    parts: list[str] = []
    place = begin
    for m in PRETOKEN.finditer(new, begin):
        parts.append(m.group())
        place = m.end()
        while place > stop + shift and last < tree.width - 1:  # this boundary is gone; go on to the next
            last += 1
            stop += tree.chars[last + tree.width]
        if place == stop + shift and place >= start + len(put):
            break
    slots = last - first + 1
    made = [parts[k : k + BLOCK] for k in range(0, len(parts), BLOCK)]
    if len(made) > slots:
        made[slots - 1 :] = [[p for b in made[slots - 1 :] for p in b]]
    for k in range(slots):
        own = made[k] if k < len(made) else []
        tree.put(first + k, sum(map(len, own)), sum(map(count, own)))
    if max(tree.chars[first + tree.width : last + 1 + tree.width], default=0) > GROWN * 8 and len(made) == slots:
        tree = CountTree(_split(new, tree, count))
    return new, tree, len(parts)


def _split(text: str, tree: CountTree, count: Counter) -> list[tuple[int, int]]:
    """The leaves, with overgrown ones cut into blocks again; leaves begin and end at pre-tokens."""
    out, start = [], 0
    for chars, tokens in tree.leaves():
        out += blocks(text[start : start + chars], count) if chars > 8 * GROWN else [(chars, tokens)]
        start += chars
    return out


RESULT = "doc_id bigint, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens bigint, n_before bigint, n_reencoded bigint"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_before", "n_reencoded"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def build(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text, the tree's leaves, n_tokens (= n_before) and n_reencoded (all pre-tokens' blocks: 0); map-only.

    A null text is empty and has a tree without leaves. Repeated rows repeat; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part[0].to_pylist(), part[1].to_pylist(), strict=True):
                found = blocks(text or "", count)
                total = sum(t for _, t in found)
                rows.append((doc_id, text or "", [c for c, _ in found], [t for _, t in found], total, total, 0))
            yield _emit(rows)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, RESULT)


def apply_edits(trees: DataFrame, tokenizer: str, edits: str = "edits") -> DataFrame:
    """Trees after `edits`, an array of (start, end, put) in code points, applied in order, each to the text so far.

    trees has the columns of `build` and `edits`; null edits change nothing, a null put removes. n_before
    keeps the count before, n_reencoded says how many pre-tokens were cut and encoded anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for part in slices(batches):
            rows = []
            for doc_id, text, chars, tokens, changes in zip(*(part[k].to_pylist() for k in range(5)), strict=True):
                tree, fresh = CountTree(list(zip(chars, tokens, strict=True))), 0
                before = tree.total
                for c in changes or []:
                    text, tree, n = edit(text, tree, c["start"], c["end"], c["put"] or "", count)
                    fresh += n
                left = tree.leaves()
                rows.append((doc_id, text, [c for c, _ in left], [t for _, t in left], tree.total, before, fresh))
            yield _emit(rows)

    return trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.col(edits).alias("edits")).mapInArrow(run, RESULT)
