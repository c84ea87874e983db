"""Exact encoding and decoding for SentencePiece models of the merge type, without the library's encoder.

A merge-type encoding is valid exactly when every two neighbouring tokens are: merging their joined
characters again must give the two back. So a text is encoded left to right. An Aho-Corasick automaton
gives the longest token that starts at each place, and a table each token's next shorter prefix; a token
is taken if it is compatible with the one before it; where none fits, the place goes into a bitfield of
failed places and the search steps back. For the same reason the encodings of two neighbouring parts of a
word, joined, are the whole's if the two tokens at the border are compatible, so parts are remembered.

An empty table gives an empty result; nulls, empty and repeated rows are described at `encode` and `decode`.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import sized, slices

SPACE = "▁"
#: Characters of texts that are encoded together; a longer text is cut before words.
BLOCK = 6_000_000
#: Slots for pairs of tokens that a worker remembers, at most; a memory filled to the half is emptied, which changes no result.
PAIRS = 1 << 22
#: Characters of a part whose failed places fit into one integer; longer parts are encoded one by one.
SHORT = 63
#: A word with the space marks before it; and its parts: letters with a space mark before them, and what lies between.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
PART = re.compile(rf"{SPACE}?[^\W\d_]+|[\W\d_]+?(?={SPACE}?[^\W\d_]|\Z)")

codecs.register_error("one_each", lambda e: ("�", e.start + 1))


class Table:
    """Values from 0 for keys from 0, as arrays of open addresses. It grows, or is emptied at `most` slots, when half full."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self._clear(slots)

    def _clear(self, slots: int) -> None:
        self.slots, self.used = slots, 0
        self.keys, self.values = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        return (mixed * np.uint64(self.slots) >> np.uint64(32)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1 where there is none."""
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held >= 0))
        keys, slot = keys[todo], slot[todo]
        while len(todo):
            slot = (slot + 1) % self.slots
            held = self.keys[slot]
            hit = held == keys
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            todo, keys, slot = todo[on], keys[on], slot[on]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds different keys that are not there."""
        if 2 * (self.used + len(keys)) > self.slots:
            old = self.keys >= 0
            held, kept = self.keys[old], self.values[old]
            self._clear(max(min(2 * self.slots, self.most), 4 << len(keys).bit_length()))
            if 2 * (len(held) + len(keys)) <= self.slots:
                self.put(held, kept)
        self.used += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys  # of several for one slot the last has it
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) % self.slots


def gathered(flat: np.ndarray, begin: np.ndarray, count: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches `which` of flat, one after another."""
    each = count[which]
    to = each.cumsum()
    return flat[np.repeat(begin[which] - (to - each), each) + np.arange(to[-1] if len(to) else 0)]


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of neighbouring values, `sizes` at a time."""
    total = np.concatenate([[0], values.cumsum()])
    stop = sizes.cumsum()
    return total[stop] - total[stop - sizes]


class Automaton:
    """Aho-Corasick over the reversed pieces, as arrays: read from the right, a state names the longest piece that starts here."""

    def __init__(self, pieces: dict[str, int]):
        goto: dict[int, int] = {}
        own = [-1]
        for piece, token in pieces.items():
            node = 0
            for c in reversed(piece):
                key = node << 21 | ord(c)
                node = goto.get(key) or goto.setdefault(key, len(own))
                if node == len(own):
                    own.append(-1)
            own[node] = token
        fail = [0] * len(own)
        # Keys of deeper nodes come after those of their parents in breadth-first order of depth.
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in goto.items():
            children.setdefault(key >> 21, []).append((key & 0x1FFFFF, node))
        level = [0]
        while level:
            below = []
            for parent in level:
                for c, node in children.get(parent, ()):
                    back = fail[parent]
                    while parent and back and back << 21 | c not in goto:
                        back = fail[back]
                    fail[node] = goto.get(back << 21 | c, 0) if parent else 0
                    if own[node] < 0:
                        own[node] = own[fail[node]]
                    below.append(node)
            level = below
        self.goto = Table(4 << len(goto).bit_length(), 4 << len(goto).bit_length())
        self.goto.put(np.array(list(goto), np.int64), np.array(list(goto.values()), np.int32))
        self.fail, self.token = np.array(fail, np.int64), np.array(own, np.int32)

    def longest(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For every place of the runs at `starts` in `chars` the longest piece that starts there and ends within the run; -1 for none."""
        out = np.full(len(chars), -1, np.int32)
        order = np.argsort(-sizes, kind="stable")
        ends, left = (starts + sizes)[order], sizes[order]
        state = np.zeros(len(order), np.int64)
        for back in range(1, int(left[0]) + 1 if len(left) else 0):
            n = int(np.searchsorted(-left, -back, "right"))  # runs at least this long
            at = ends[:n] - back
            state = self._step(state[:n], chars[at])
            out[at] = self.token[state]
        return out

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        found = self.goto.get(state << 21 | char).astype(np.int64)
        todo = np.flatnonzero((found < 0) & (state > 0))
        state, char = self.fail[state[todo]], char[todo]
        while len(todo):
            on = self.goto.get(state << 21 | char)
            found[todo] = on
            left = (on < 0) & (state > 0)
            todo, state, char = todo[left], self.fail[state[left]], char[left]
        return np.maximum(found, 0)


class MergeModel:
    """The vocabulary of one model file, and its encoder and decoder."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.count = len(self.pieces)
        self.bytes_id: dict[int, int] = {}
        self.rank: dict[str, tuple[float, int]] = {}
        shown: list[bytes] = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes_id[int(piece[3:5], 16)] = i
                shown.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                shown.append(b"")
            elif model.is_unknown(i):
                shown.append(" ⁇ ".encode())
            else:
                self.rank[piece] = (model.get_score(i), i)
                shown.append(piece.replace(SPACE, " ").encode())
        self.shown = pa.array(shown, pa.binary())
        self.led = np.array([p[0] == SPACE and bool(x) for p, x in zip(self.pieces, shown, strict=True)])
        self.unseen = np.array([not x for x in shown])
        self.automaton = Automaton({p: i for p, (_, i) in self.rank.items()})
        self.length = np.array([len(p) for p in self.pieces])
        self.shorter = np.array([self._prefix(p) if p in self.rank else -1 for p in self.pieces])
        self.known = {p for p in self.rank if len(p) == 1}
        self.pairs = Table(1 << 18, PAIRS)
        self.char_known = np.zeros(0x110000, bool)
        self.char_known[[ord(c) for c in self.known]] = True
        self.long_runs = ahocorasick.Automaton()
        for piece, (_, i) in self.rank.items():
            self.long_runs.add_word(piece, (len(piece) - 1, i))
        self.long_runs.make_automaton()
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece goes on past a word into a space; such models are not supported")
        self.whole: dict[int, bool] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.score = [model.get_score(i) for i in range(self.count)]
        self.shared = {s for s, n in Counter(s for s, _ in self.rank.values()).items() if n > 1}

    def _prefix(self, piece: str) -> int:
        """The longest token that begins a piece and is shorter; -1 for none."""
        return next((self.rank[piece[:k]][1] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.rank), -1)

    def merge(self, text: str) -> list[int]:
        """The model's definition, for the short texts of the checks: always merge the best pair, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((r[0], -k) for k in range(len(parts) - 1) if (r := self.rank.get(parts[k] + parts[k + 1]))), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.rank[p][1] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single character."""
        if token not in self.made_of:
            parts = list(self.pieces[token])
            while len(parts) > 2:
                k = -max(((r[0], -k) for k in range(len(parts) - 1) if (r := self.rank.get(parts[k] + parts[k + 1]))))[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.made_of[token] = tuple(self.rank[p][1] for p in parts) if len(parts) == 2 else None
        return self.made_of[token]

    def reachable(self, token: int) -> bool:
        """Whether merging a token's own characters gives the token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.pieces[token]) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined characters again gives these two tokens; a left of -1 is the start, and what
        stands for a byte merges with nothing.

        The re-merging is followed backwards at the border alone: of the two tokens that face each other
        the later made one is undone, and the two that then face each other must not have a merge of
        their own that would have come first. Tokens of equal score go through the definition itself.
        """
        if self.pieces[right] not in self.rank:
            return True
        if not self.reachable(right):
            return False
        if left < 0 or self.pieces[left] not in self.rank:
            return True
        if self.score[left] in self.shared or self.score[right] in self.shared:
            return self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return self._keep_apart(left, right)

    def _keep_apart(self, left: int, right: int) -> bool:
        score, pieces, rank = self.score, self.pieces, self.rank
        until, tie = -math.inf, False
        while True:
            joined = rank.get(pieces[left] + pieces[right])
            if joined and (joined[0] > until or tie and joined[0] == until):
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and score[left] < score[right]:
                until, tie, left = score[left], False, a[1]
            else:
                until, tie, right = score[right], True, b[0]  # of equal merges the one at the border is further left

    def all_compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`compatible` of many pairs; those not met before are looked into once and remembered."""
        keys = (left.astype(np.int64) + 1) * self.count + right
        fits = self.pairs.get(keys)
        unknown = fits < 0
        if unknown.any():
            new, place = np.unique(keys[unknown], return_inverse=True)
            found = np.array([self.compatible(k // self.count - 1, k % self.count) for k in new.tolist()], np.int32)
            self.pairs.put(new, found)
            fits[unknown] = found[place]
        return fits == 1

    def backtrack(self, run: str) -> list[int]:
        """Tokens of one run of known characters of any length."""
        last = len(run)
        longest = [-1] * last
        for end, (back, token) in self.long_runs.iter(run):
            longest[end - back] = token  # of those with one start the longest ends last
        length, shorter, pairs = self.length, self.shorter, {}
        failed: bytearray | None = None
        taken: list[int] = []
        place, before, token = 0, -1, longest[0]
        while place < last:
            while token >= 0:
                after = place + int(length[token])
                if failed is None or not failed[after >> 3] >> (after & 7) & 1:
                    fits = pairs.get((before, token))
                    if fits is None:
                        fits = pairs[before, token] = self.compatible(before, token)
                    if fits:
                        taken.append(token)
                        place, before = after, token
                        if place < last:
                            token = longest[place]
                        break
                token = int(shorter[token])
            else:
                if failed is None:
                    failed = bytearray((last >> 3) + 1)
                failed[place >> 3] |= 1 << (place & 7)
                before = taken.pop()
                place -= int(length[before])
                before, token = taken[-1] if taken else -1, int(shorter[before])
        return taken

    def backtrack_all(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many runs of 1 to SHORT known characters, all in step, and how many each has."""
        n_runs, starts = len(sizes), sizes.cumsum() - sizes
        longest = self.automaton.longest(chars, starts, sizes)
        length, shorter = self.length, self.shorter
        taken = np.zeros((n_runs, int(sizes.max(initial=0))), np.int32)
        place, depth = np.zeros(n_runs, np.int64), np.zeros(n_runs, np.int64)
        before, failed = np.full(n_runs, -1, np.int64), np.zeros(n_runs, np.uint64)
        token = longest[starts].astype(np.int64)
        active = np.arange(n_runs)
        bit = np.uint64(1)
        while len(active):
            stuck = token[active] < 0
            back, go = active[stuck], active[~stuck]
            if len(back):
                failed[back] |= bit << place[back].astype(np.uint64)
                depth[back] -= 1
                last = taken[back, depth[back]]
                place[back] -= length[last]
                token[back] = shorter[last]
                before[back] = np.where(depth[back] > 0, taken[back, depth[back] - 1], -1)
            after = place[go] + length[token[go]]
            fits = (failed[go] >> after.astype(np.uint64) & bit) == 0
            fits[fits] = self.all_compatible(before[go[fits]], token[go[fits]])
            yes, no = go[fits], go[~fits]
            token[no] = shorter[token[no]]
            taken[yes, depth[yes]] = token[yes]
            depth[yes] += 1
            before[yes] = token[yes]
            place[yes] = after[fits]
            on = place[yes] < sizes[yes]
            further = yes[on]
            token[further] = longest[starts[further] + place[further]]
            active = np.concatenate([back, no, further])
        return taken[np.arange(taken.shape[1]) < depth[:, None]], depth

    def one(self, part: str) -> list[int]:
        """Tokens of any text by itself: runs of known characters, and the others by their bytes."""
        known = self.known
        if known.issuperset(part):
            return self.backtrack(part)
        out: list[int] = []
        start = 0
        for k, c in enumerate(part):
            if c not in known:
                out += self.backtrack(part[start:k]) if start < k else ()
                out += [self.bytes_id.get(b, 0) for b in c.encode()]
                start = k + 1
        out += self.backtrack(part[start:]) if start < len(part) else ()
        return out

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of different parts, where each part's begin and how many it has."""
        sizes = np.array([len(p) for p in parts], np.int64)
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
        quick = (sizes <= SHORT) & (summed(self.char_known[chars], sizes) == sizes)
        ids, n = self.backtrack_all(chars[np.repeat(quick, sizes)], sizes[quick])
        slow = [self.one(parts[k]) for k in np.flatnonzero(~quick)]
        count, begin = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        count[quick], count[~quick] = n, [len(x) for x in slow]
        begin[quick], begin[~quick] = n.cumsum() - n, len(ids) + count[~quick].cumsum() - count[~quick]
        return np.concatenate([ids, np.array(list(chain.from_iterable(slow)), np.int32)]), begin, count

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for different words, each given without its first space mark."""
        found = [PART.findall(SPACE + w) for w in words]
        n_parts = np.array([len(f) for f in found], np.int64)
        coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        ids, begin, count = self._parts(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        inner = np.ones(len(which), bool)
        inner[n_parts.cumsum() - n_parts] = False
        border = np.flatnonzero(inner)
        left, right = which[border - 1], which[border]
        apart = self.all_compatible(ids[begin[left] + count[left] - 1], ids[begin[right]])
        flat, size = gathered(ids, begin, count, which), summed(count[which], n_parts)
        start = size.cumsum() - size
        if not apart.all():  # a merge would go on across a border: these words are encoded whole
            bad = np.unique(np.searchsorted(n_parts.cumsum(), border[~apart], "right"))
            whole = [self.one(SPACE + words[k]) for k in bad.tolist()]
            size[bad] = [len(x) for x in whole]
            start[bad] = len(flat) + size[bad].cumsum() - size[bad]
            flat = np.concatenate([flat, np.array(list(chain.from_iterable(whole)), np.int32)])
        return flat, start, size

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts, each given without its first space mark, and how many each has."""
        plain = lambda t: t[0] != " " and "  " not in t
        found = [t.split(" ") if plain(t) else [w[1:] for w in WORD.findall(SPACE + t.replace(" ", SPACE))] for t in texts]
        n_words = np.array([len(f) for f in found], np.int64)
        coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        ids, begin, count = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return gathered(ids, begin, count, which), summed(count[which], n_words)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and where each text's end. A text gets the model's leading space; no piece goes on past a word into a space."""
        counts = np.zeros(len(texts), np.int64)
        out, held, owners, size = [np.empty(0, np.int32)], [], [], 0

        def flush() -> None:
            flat, n = self._block(held)
            np.add.at(counts, owners, n)
            out.append(flat)
            held.clear(), owners.clear()

        for k, text in enumerate(texts):
            for chunk in chunks(text.replace(SPACE, " ")) if text else ():
                if held and size + len(chunk) > BLOCK:
                    flush()
                    size = 0
                held.append(chunk)
                owners.append(k)
                size += len(chunk)
        if held:
            flush()
        return np.concatenate(out), counts.cumsum()

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of the ids up to each end, one lookup for all."""
        shown = self.shown.take(pa.array(ids))
        buffer = memoryview(shown.buffers()[2] or b"")
        at = np.frombuffer(shown.buffers()[1], np.int32)[shown.offset : shown.offset + len(ids) + 1]
        # Of ids that show nothing, the first that shows something decides about the leading space.
        led = np.append(self.led[ids], False)
        if self.unseen[ids].any():
            seen = np.append(np.flatnonzero(~self.unseen[ids]), len(ids))
            led = led[seen[np.searchsorted(seen, np.arange(len(ids) + 1))]]
        out, start = [], 0
        for end in ends.tolist():
            a, b = int(at[start]), int(at[end])
            out.append(bytes(buffer[a + 1 if a < b and led[start] else a : b]).decode("utf-8", "one_each"))
            start = end
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


def chunks(text: str) -> Iterator[str]:
    """A text in chunks of about BLOCK characters, cut at the space before a word, which is left out."""
    start = 0
    while len(text) - start > BLOCK:
        at = text.find(" ", start + BLOCK)
        while at > 0 and (text[at - 1] == " " or text[at + 1 : at + 2] in ("", " ")):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at + 1
    yield text[start:]


@cache
def merge_model(path: str) -> MergeModel:
    return MergeModel(path)


def _others(df: DataFrame, keep: list[str] | None, made: list[str]) -> list[str]:
    return [c for c in (df.columns if keep is None else keep) if c not in made]


def encode(df: DataFrame, model: str, text: str = "text", to: str = "ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Adds the ids of column `text` and, if `decoded` names a column, the text that they decode to; map-only.

    Null and empty texts get no ids and the empty text. `keep` names the other columns that stay (all by
    default). Columns that are already called so are replaced. Repeated rows give repeated rows.
    """
    made = [to] if decoded is None else [to, decoded]
    others = _others(df, keep, made)
    rows = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("_encoded_text"))
    kinds = [T.StructField(to, T.ArrayType(T.IntegerType())), T.StructField(decoded or "", T.StringType())][: len(made)]
    schema = T.StructType([*rows.schema.fields[:-1], *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merge_model(model)
        for part in sized(batches, len(others), BLOCK):
            ids, ends = own.encode_all([x or "" for x in part[len(others)].to_pylist()])
            columns = [*part.columns[:-1], pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids))]
            if decoded is not None:
                columns.append(pa.array(own.decode_all(ids, ends), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *made])

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", to: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds the text of the ids; map-only. Null ids decode to the empty text. Bytes that are no UTF-8 become U+FFFD each."""
    others = _others(df, keep, [to])
    rows = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{ids}`").alias("_decoded_ids"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merge_model(model)
        for part in slices(batches):
            each = [np.array(x or [], np.int32) for x in part[len(others)].to_pylist()]
            texts = own.decode_all(np.concatenate(each), np.cumsum([len(x) for x in each]))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*others, to])

    return rows.mapInArrow(run, schema)
