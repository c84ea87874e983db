"""Repair of conversations by the cheapest edits, with Hirschberg's divide and conquer.

A repaired conversation's role initials read `(s?(ua)+)?`: nothing, or perhaps a system turn and then user and
assistant in turns. Every row is kept (0), given the role that is due (3) or deleted (4; blank and repeated rows must
be), and turns with an empty text are inserted (3 each); a truncated row that stays adds 3. What
may follow depends on one of four states: nothing yet, after the system turn, after a user, after an assistant.

A stretch of rows is a table of 4 by 4 costs, and tables of neighbouring stretches combine, so a long
conversation is cut into pieces that many tasks work off:

1. Rows are narrowed to a code (role initial, faults) and the MD5 of the text; equal rows are one with a
   count. They are put into one order by range, and each run of a conversation in it becomes pieces of at most PIECE rows.
2. Over the tables of a conversation's pieces, forward and backward cost vectors meet at each border: the
   states at which their sum is least are the optimal crossings.
3. Within a piece the same is done at its middle, and again in both halves (`solve`): of equally cheap edits those whose
   initials are the least in ASCII are taken. As the left half's edits end with that of a row, no left half's initials begin
   another's, so the least whole has the least left half, and its end is the crossing. Space stays linear.
   A piece is solved for each optimal crossing at its start, as which of these is taken depends on the pieces before.
4. The texts, in the same order, are streamed past the edits of their conversation.

One task reads a conversation's texts in step 4, as a SHA-256 cannot be computed in parts; it holds a letter for each
row and a batch of texts. Nulls in role and text count as one space and a null turn comes first; rows of the same turn are
ordered by role, then by the MD5 of the text. A null conv_id is a conversation of its own. A role that begins with none of
s, u and a can be changed or deleted, not kept. Repeated rows are duplicates; extra columns are not looked at. A
conversation without rows has zeros, an empty audit and the hash of the empty text; an empty table an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable

PIECE = 65_536
RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Codes of rows: the place of the role's initial here (else OTHER), CUT more if truncated, or GONE if it must be deleted.
INITIALS, OTHER, CUT, GONE = "sua", 3, 4, 8
NEVER = 1 << 60
#: The state after an insertion or a change of role.
DUE = (USER, USER, ASSISTANT, USER)
#: Where the initials s, u and a lead from each state, if they may follow.
NEXT = ((SYSTEM, USER, None), (None, USER, None), (None, None, ASSISTANT), (None, USER, None))
#: The cost of ending in each state: of the insertions that are still due.
END = (0, 2 * INSERT, INSERT, 0)


def _moves(code: int, state: int) -> list[tuple[int, str, int]]:
    """(cost, initials, state) of every way over one row: up to two insertions, then the row's own edit."""
    out = []
    for n in range(3):
        options = [(DELETE, "D", state)]
        if code != GONE:
            more = TRUNCATED if code & CUT else 0
            options.append((RETYPE + more, "R", DUE[state]))
            if code % CUT != OTHER and (to := NEXT[state][code % CUT]) is not None:
                options.append((more, "K", to))
        out += [(n * INSERT + cost, "I" * n + letter, to) for cost, letter, to in options]
        state = DUE[state]
    return out


MOVES = [[_moves(code, s) for s in range(4)] for code in range(GONE + 1)]
#: Least cost over a row of each code from each state to each.
STEP = np.array([[[min((c for c, _, to in MOVES[code][s] if to == t), default=NEVER) for t in range(4)] for s in range(4)] for code in range(GONE + 1)])


def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs over two stretches in a row, for one or many of them."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), NEVER)


def table(codes: np.ndarray) -> np.ndarray:
    """Costs from each state to each over a stretch of rows."""
    parts = STEP[codes]
    while len(parts) > 1:
        if len(parts) % 2:
            parts = np.concatenate([parts[:-2], over(parts[-2:-1], parts[-1:])])
        if len(parts) > 1:
            parts = over(parts[::2], parts[1::2])
    return parts[0]


def solve(codes: np.ndarray, start: int, end: list[int]) -> tuple[str, int]:
    """(initials, state): the cheapest edits over the rows from a state, where ending in each state costs `end`; of equal ones the ASCII-least."""
    if len(codes) == 1:
        _, letters, state = min((cost + end[to], letters, to) for cost, letters, to in MOVES[codes[0]][start])
        return letters, state
    middle = len(codes) // 2
    forward = table(codes[:middle])[start]
    backward = (table(codes[middle:]) + np.array(end)).min(axis=1)
    meet = forward + backward
    # Only optimal crossings stay; where there are several, the least left half takes one.
    left, state = solve(codes[:middle], start, [int(b) if m == meet.min() else NEVER for b, m in zip(backward, meet, strict=True)])
    right, last = solve(codes[middle:], state, end)
    return left + right, last


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults: by a hash of conversation and turn, of 20 rows one each is dropped, emptied, stripped of `[.!?]`, repeated and given the role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), times.alias("copy")).drop("copy")


CONVERSATION, ORDER = ["named", "conv"], ["timed", "turn", "role", "mark"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Keys without nulls: conversation, then the order of its rows, with role and text."""
    given = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("at"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return given.select(*_conversation(), F.col("at").isNotNull().alias("timed"), F.coalesce("at", F.lit(0)).alias("turn"), "role", F.md5("text").alias("mark"), "text")


def _conversation() -> list[Column]:
    return [F.col("conv_id").isNotNull().alias("named"), F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv")]


def _codes(rows: DataFrame) -> DataFrame:
    """One narrow row for all equal ones, with n, initial, blank, cut and later (its role and text are seen in an earlier turn)."""
    shown = "[^\\x20\\x09-\\x0D]"
    last = F.regexp_extract("text", f"({shown})[\\x20\\x09-\\x0D]*\\z", 1)
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, k) for k, c in enumerate(INITIALS)], F.lit(OTHER))
    marked = rows.select(*CONVERSATION, *ORDER, initial.alias("initial"), (~F.col("text").rlike(shown)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    once = marked.groupBy(*CONVERSATION, *ORDER).agg(F.count("*").alias("n"), F.min("initial").alias("initial"), F.min("blank").alias("blank"), F.min("cut").alias("cut"))
    said = [*CONVERSATION, "role", "mark"]
    again = once.groupBy(*said).agg(F.count("*").alias("turns"), F.min(F.struct("timed", "turn")).alias("first")).filter("turns > 1").drop("turns")
    return once.join(again, said, "left").withColumn("later", F.coalesce(F.struct("timed", "turn") > F.col("first"), F.lit(False))).drop("first")


def _pieces(codes: DataFrame) -> DataFrame:
    """Pieces of conversations in order: no, codes, costs (the 4 by 4 table, copies' deletions included) and what the report adds up."""
    ordered = codes.repartitionByRange(*CONVERSATION, *ORDER).sortWithinPartitions(*CONVERSATION, *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            fresh = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("named", "conv", "timed", "turn", "n", "initial", "blank", "cut", "later")}
            held = fresh if held is None else {c: np.concatenate([held[c], x]) for c, x in fresh.items()}
            new = np.flatnonzero((held["conv"][1:] != held["conv"][:-1]) | (held["named"][1:] != held["named"][:-1])) + 1
            cuts = [0, *new.tolist()]
            cuts = [c for a, b in zip(cuts, [*cuts[1:], len(held["conv"])], strict=True) for c in range(a, b, PIECE)]
            out = [summed({c: x[a:b] for c, x in held.items()}, base + made + k) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            held, made = {c: x[cuts[-1] :] for c, x in held.items()} if cuts else held, made + len(out)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=PIECES)
        if held is not None and len(held["conv"]):
            yield pa.RecordBatch.from_pylist([summed(held, base + made)], schema=PIECES)

    return ordered.mapInArrow(run, PIECE_COLUMNS)


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
PIECE_COLUMNS = "named boolean, conv bigint, no bigint, codes binary, costs array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first int, last int, turns bigint, low bigint, high bigint"
PIECES = pa.schema([("named", pa.bool_()), ("conv", pa.int64()), ("no", pa.int64()), ("codes", pa.binary()), ("costs", pa.list_(pa.int64())), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.int32()), ("last", pa.int32()), *((c, pa.int64()) for c in ("turns", "low", "high"))])


def summed(rows: dict[str, np.ndarray], no: int) -> dict:
    """A piece's row of PIECES."""
    initial, n, blank, later, cut = (rows[c] for c in ("initial", "n", "blank", "later", "cut"))
    codes = np.where(blank | later, GONE, initial + CUT * cut).astype(np.uint8)
    follows = np.isin(initial[:-1] * 4 + initial[1:], [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
    turns = np.unique(rows["turn"][rows["timed"]])
    copies = int((n - 1).sum())
    return {
        "named": bool(rows["named"][0]), "conv": int(rows["conv"][0]), "no": no, "codes": codes.tobytes(),
        "costs": np.minimum(table(codes) + DELETE * copies, NEVER).reshape(-1).tolist(),
        "blank": int(n[blank].sum()), "duplicate": int(n[~blank & later].sum() + (n - 1)[~blank & ~later].sum()), "truncated": int((~blank & ~later & cut).sum()),
        "illegal": copies + int((~follows).sum()), "first": int(initial[0]), "last": int(initial[-1]),
        "turns": len(turns), "low": int(turns[0]) if len(turns) else None, "high": int(turns[-1]) if len(turns) else None,
    }


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of each conversation, streamed, from batches that are sorted by it."""
    rows = (row for batch in batches for start in range(0, batch.num_rows, 512) for row in batch.slice(start, 512).to_pylist())
    return groupby(rows, key=lambda r: (r["named"], r["conv"]))


def _crossings(pieces: DataFrame) -> DataFrame:
    """For each piece the optimal states at its start and what ending in each state costs, and with a conversation's first piece its report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in _by_conversation(batches):
            own = list(rows)  # a row for each PIECE rows
            costs = [np.array(r["costs"]).reshape(4, 4) for r in own]
            backward = [np.array(END)]
            for c in reversed(costs):
                backward.append(np.minimum((c + backward[-1]).min(axis=1), NEVER))
            backward.reverse()
            forward, best, report = np.array([0, NEVER, NEVER, NEVER]), int(backward[0][START]), dict.fromkeys(REPORT, 0)
            for k, r in enumerate(own):
                after = np.minimum((forward[:, None] + costs[k]).min(axis=0), NEVER)
                end = [int(b) if a + b == best else NEVER for a, b in zip(after, backward[k + 1], strict=True)]
                out.append({"named": r["named"], "conv": r["conv"], "no": r["no"], "starts": np.flatnonzero(forward + backward[k] == best).tolist(), "ends": end, **dict.fromkeys(REPORT)})
                forward = after
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    report[c] += r[c]
                if k:
                    before = own[k - 1]
                    report["illegal"] += (before["last"], r["first"]) not in ((0, 1), (1, 2), (2, 1))
            timed = [r for r in own if r["turns"]]
            if timed:
                shared = sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
                report["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - sum(r["turns"] for r in timed) + shared
            out[-len(own)].update(report | {"cost": best})
            if len(out) > 1_000:
                yield pa.RecordBatch.from_pylist(out, schema=CROSSED)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=CROSSED)

    narrow = pieces.drop("codes").repartition(*CONVERSATION).sortWithinPartitions(*CONVERSATION, "no")
    return narrow.mapInArrow(run, f"named boolean, conv bigint, no bigint, starts array<int>, ends array<bigint>, {', '.join(f'{c} bigint' for c in REPORT)}")


CROSSED = pa.schema([("named", pa.bool_()), ("conv", pa.int64()), ("no", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), *((c, pa.int64()) for c in REPORT)])


def _solved(pieces: DataFrame) -> DataFrame:
    """Each piece's edits from each optimal state at its start: start, finish and edits."""
    keys = [*CONVERSATION, "no"]
    given = pieces.select(*keys, "codes").join(_crossings(pieces), keys).select(*keys, "codes", F.explode("starts").alias("start"), "ends", *REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(np.frombuffer(c, np.uint8), s, e) for c, s, e in zip(*(batch[k].to_pylist() for k in ("codes", "start", "ends")), strict=True)]
            kept = [batch[c] for c in (*keys, "start", *REPORT)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x for _, x in found], pa.int32()), pa.array([x for x, _ in found], pa.string())], names=[*keys, "start", *REPORT, "finish", "edits"])

    return given.mapInArrow(run, f"named boolean, conv bigint, no bigint, start int, {', '.join(f'{c} bigint' for c in REPORT)}, finish int, edits string")


REPAIRED = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in REPORT), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _told(key: tuple, rows: Iterator[dict]) -> dict:
    """A conversation's result from its pieces' edits and then its texts."""
    report, edits, state, letters = dict.fromkeys(REPORT, 0), [], START, None
    audit, digest, any_yet, last = [], hashlib.sha256(), False, None

    def say(role: str, text: str) -> None:
        nonlocal any_yet
        digest.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode())
        any_yet = True

    def insert() -> None:
        nonlocal state
        state = DUE[state]
        audit.append("I")
        say(NAMES[state], "")

    for r in rows:
        if r["edits"] is not None:
            if r["cost"] is not None and not edits:
                report = {c: r[c] for c in REPORT}
            if r["start"] == state:  # of a piece solved from several states, the one that the piece before ends in
                edits.append(r["edits"])
                state = r["finish"]
            continue
        if r["mark"] is None:
            continue
        if letters is None:
            letters, state = (x for part in edits for x in part), START
        own = tuple(r[c] for c in ORDER)
        if own == last:  # a copy
            audit.append("D")
            continue
        last = own
        while (letter := next(letters)) == "I":
            insert()
        audit.append(letter)
        if letter == "R":
            state = DUE[state]
            say(NAMES[state], r["text"])
        elif letter == "K":
            state = NEXT[state][INITIALS.index(r["role"][0])]
            say(r["role"], r["text"])
    while END[state]:
        insert()
    return {"conv_id": key[1] if key[0] else None, **report, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conv_id of `conversations`, from rows (conv_id, turn, role, text)."""
    keyed = _keyed(rows)
    solved = _solved(durable(_pieces(_codes(keyed))))
    names = conversations.select(*_conversation()).distinct()
    empty = lambda df, kind, *has: df.select(*CONVERSATION, F.lit(kind).alias("kind"), *[F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in STREAM.items()])
    stream = empty(names, 0).unionByName(empty(solved, 1, "no", "start", "finish", "edits", *REPORT)).unionByName(empty(keyed, 2, *ORDER, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, own in _by_conversation(batches):
            out.append(_told(key, own))
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, schema=REPAIRED)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=REPAIRED)

    together = stream.repartition(*CONVERSATION).sortWithinPartitions(*CONVERSATION, "kind", "no", "start", *ORDER)
    return together.mapInArrow(run, f"conv_id bigint, {', '.join(f'{c} bigint' for c in REPORT)}, audit string, repaired_sha256 string")


STREAM = {"no": "bigint", "start": "int", "finish": "int", "edits": "string", **dict.fromkeys(REPORT, "bigint"), "timed": "boolean", "turn": "bigint", "role": "string", "mark": "string", "text": "string"}


def _sql() -> str:
    """The same for DuckDB: for each state the cheapest edits so far with their initials and texts, row by row."""
    put = lambda b, cost, letters, said: f"struct_pack(c := {b}.c + {cost}, a := {b}.a || '{letters}', r := {b}.r || {said})"
    inserted = lambda b, n, *roles: put(b, 3 * n, "I" * n, " || ".join(f"chr(10) || '{x}:'" for x in roles))
    least = lambda *x: f"list_min([{', '.join(x)}])"
    row = "chr(10) || o.role || ':' || o.text"
    more = "(CASE WHEN o.cut THEN 3 ELSE 0 END)"
    when = lambda c, x: f"CASE WHEN {c} THEN {x} END"
    gone = [put(f"i.b{s}", 4, "D", "''") for s in range(4)]
    changed = lambda s, name: when("NOT o.gone", put(f"i.b{s}", f"3 + {more}", "R", f"chr(10) || '{name}:' || o.text"))
    kept = lambda s, letter: when(f"NOT o.gone AND o.initial = '{letter}'", put(f"i.b{s}", more, "K", row))
    to = [
        gone[0],
        least(gone[1], kept(0, "s")),
        least(gone[2], *(x for s in (0, 1, 3) for x in (changed(s, "user"), kept(s, "u")))),
        least(gone[3], changed(2, "assistant"), kept(2, "a")),
    ]
    user = least("f.b2", inserted("f.b0", 1, "user"), inserted("f.b1", 1, "user"), inserted("f.b3", 1, "user"))
    assistant = least("f.b3", inserted("f.b2", 1, "assistant"), inserted("f.b0", 2, "user", "assistant"), inserted("f.b1", 2, "user", "assistant"))
    none = "struct_pack(c := 1000000000, a := '', r := '')"
    final = least("f.b0", "f.b3", inserted("f.b2", 1, "assistant"), inserted("f.b1", 2, "user", "assistant"))
    shown = r"[^\x20\x09-\x0D]"
    return rf"""WITH RECURSIVE poly AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS s FROM conversations),
hashed AS (SELECT g.*, xor(list_reduce(list_prepend(4294967295, list_transform(s, lambda x: ord(x)::BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM given g, poly),
kept AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hashed, LATERAL unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) c(copy) WHERE kind <> 0),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM kept),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM ordered),
o AS MATERIALIZED (SELECT *, NOT regexp_matches(text, '{shown}') AS blank, regexp_extract(text, '({shown})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS ends_cut, NOT regexp_matches(text, '{shown}') OR again AS gone, regexp_extract(text, '({shown})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AND NOT again AS cut, substring(role, 1, 1) AS initial,
  lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substring(role, 1, 1) NOT IN ('su', 'ua', 'au') AS odd FROM placed),
f AS (SELECT conv_id, 0::BIGINT AS i, struct_pack(c := 0, a := '', r := '') AS b0, {none} AS b1, {none} AS b2, {none} AS b3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT i.conv_id, o.i, {to[0]}, {to[1]}, {to[2]}, {to[3]} FROM (SELECT conv_id, i, b0, b1, {user} AS b2, {assistant} AS b3 FROM f) i JOIN o ON o.conv_id IS NOT DISTINCT FROM i.conv_id AND o.i = i.i + 1),
best AS (SELECT conv_id, {final} AS e FROM f WHERE i = (SELECT count(*) FROM o WHERE o.conv_id IS NOT DISTINCT FROM f.conv_id)),
report AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT gone AND cut) AS truncated, count(*) FILTER (odd) AS illegal FROM o GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.c::BIGINT AS cost, e.a AS audit, sha256(substring(e.r, 2)) AS repaired_sha256
FROM best b LEFT JOIN report r ON r.conv_id IS NOT DISTINCT FROM b.conv_id"""


SQL = _sql()
