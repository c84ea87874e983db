"""Top-k search, hard negatives and conversation repair against brute force, and on the awkward rows."""

import glob
import hashlib
import heapq
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import conversation_repair as cr
from lectern.llm import hard_negatives, queries, voronoi

KIND = "vec_id bigint, embedding array<float>, label int, whole string, score string, cell string, rank string, summary string"


def rows_of(n, seed, width=12, hot=0):
    """Vectors in clusters, `hot` of them equal."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    which = rng.integers(0, 5, n)
    x = centres[which] + 0.4 * rng.normal(size=(n, width))
    x[1 : hot + 1] = x[0]
    return [(i, [float(np.float32(v)) for v in x[i]], int(which[i]), *["clash"] * 5) for i in range(n)]


ODD = [
    (None, [1.0, 2.0], 1), (7000, None, 1), (7001, [None, 1.0], 1), (7002, [float("nan"), 1.0], 1), (7003, [float("inf"), 1.0], 1), (7100, [], 2), (7101, [0.5], 2), (7102, [0.0] * 40, None),
    (7200, [1.5] * 12, 3), (7200, [1.5] * 12, 3), (7201, [1.5] * 12, 3), (7201, [1.5] * 12, 3), (7202, [1.5] * 12, 4),
]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    return spark.createDataFrame(rows_of(300, 3, hot=90) + [(*r, *["clash"] * 5) for r in ODD], KIND)


def usable(rows, scale, labelled=False):
    out = []
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is None or v is None or any(x is None or not math.isfinite(x) for x in v) or labelled and r["label"] is None:
            continue
        out.append((r["vec_id"], [math.floor(scale * x) for x in v], r["label"] if "label" in r else None))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute_top(rows, k, scale, every=100):
    own = usable(rows, scale)
    out = []
    for q in sorted({r[0] for r in own if r[0] % every == 0}):
        vector = min(r[1] for r in own if r[0] == q)
        found = sorted((-dot(vector, r[1]), r[0]) for r in own if r[0] != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_scores_equal_all_pairs(odd_vectors):
    want = brute_top(odd_vectors.collect(), 4, 1024, 20)
    for more in ({}, {"group": 3, "part": 16, "pivots": 9}, {"pivots": 1}):
        got = voronoi.top_scores(odd_vectors, F.col("vec_id") % 20 == 0, k=4, **more)
        assert sorted(map(tuple, got.collect())) == want and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_top_scores_of_spread_lengths(spark):
    """Rows of very different lengths: the highest inner products are not the nearest rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) * np.exp(rng.normal(size=(400, 1)) * 2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = voronoi.top_scores(rows, F.col("vec_id") % 10 == 0, k=5, group=8, part=64, pivots=12)
    assert sorted(map(tuple, got.collect())) == brute_top(rows.collect(), 5, 1024, 10)


def test_rows_go_only_to_groups_that_need_them(spark):
    """Far clusters: a row meets fewer groups than there are, and nothing is lost."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(100, 4)) * 0.01 + c for c in np.eye(4)[:, None, :] * np.array([[3.0]])])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    space = voronoi.Space(np.floor(x * 1024), float((np.floor(x * 1024) ** 2).sum(axis=1).max()), 4)
    celled = voronoi.cells(rows, space, 1024).toPandas()
    assert len(celled["cell"].unique()) == 4
    got = voronoi.top_scores(rows, F.col("vec_id") % 10 == 0, k=3, group=1, pivots=4)
    assert sorted(map(tuple, got.collect())) == brute_top(rows.collect(), 3, 1024, 10)


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([], KIND)
    one = spark.createDataFrame([(1, [1.0], 1, *["clash"] * 5)], KIND)
    alone = spark.createDataFrame([(100, [1.0], 1, *["clash"] * 5)], KIND)
    for rows in (none, one, alone):
        assert voronoi.top_scores(rows, F.col("vec_id") % 100 == 0).collect() == []
        assert hard_negatives.mine(rows, F.col("vec_id") % 100 == 0).collect() == []


def brute_hard(rows, positives, negatives, every):
    own = usable(rows, 256, labelled=True)
    out = set()
    for a in sorted({r[0] for r in own if r[0] % every == 0}):
        label, vector = min((r[2], r[1]) for r in own if r[0] == a)
        others = sorted((-dot(vector, r[1]), r[0], r[2]) for r in own if r[0] != a)
        for s, p, _ in [o for o in others if o[2] == label][:positives]:
            fits = [o for o in others if o[2] != label and 80 * -s <= 100 * -o[0] <= 100 * -s][:negatives]
            out |= {(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(fits)}
    return sorted(out)


def test_hard_negatives_equal_all_pairs(odd_vectors):
    want = brute_hard(odd_vectors.collect(), 3, 4, 20)
    assert len(want) > 50
    for sent in (1 << 20, 0):
        got = hard_negatives.mine(odd_vectors, F.col("vec_id") % 20 == 0, 3, 4, sent_bytes=sent)
        assert sorted(map(tuple, got.collect())) == want


def test_segment_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = (np.floor(rng.normal(size=(50, 30)) * 100) for _ in range(2))
    exact, last = a @ b.T, None
    for length in hard_negatives.LENGTHS:
        (m, d), (n, e) = hard_negatives.segments(a, length), hard_negatives.segments(b, length)
        low, high = length * (m @ n.T - d @ e.T), length * (m @ n.T + d @ e.T)
        assert (low <= exact + 1e-6).all() and (high >= exact - 1e-6).all()
        assert last is None or (high - low).mean() < last  # shorter segments bound more tightly
        last = (high - low).mean()


@pytest.mark.parametrize("name", ["op11_voronoi_top_k", "op12_hard_negatives", "op13_conversation_repair"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_query_equals_sql(spark, name, size):
    con = duckdb.connect()
    for path in glob.glob(f"/root/testdata/{size}/*s.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, f"/root/testdata/{size}").select(names)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


# 13 conversations


def brute_edits(codes, start=cr.START):
    """Least (cost, initials) by a search over (row, state) that keeps the least of each place."""
    heap, seen = [(0, "", 0, start)], set()
    while heap:
        cost, letters, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(codes) and state in (cr.START, cr.ASSISTANT):
            return cost, letters
        heapq.heappush(heap, (cost + 3, letters + "I", i, cr.DUE[state]))
        if i < len(codes):
            code = codes[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, state))
            if code != cr.GONE:
                more = 3 if code & cr.CUT else 0
                heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, cr.DUE[state]))
                if code % 4 != cr.OTHER and (to := cr.NEXT[state][code % 4]) is not None:
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, to))


def test_least_edits():
    rng = random.Random(4)
    for n in [1, 2, 3, 5, 8, 13, 40] * 30:
        codes = np.array([rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8]) for _ in range(n)], np.uint8)
        letters, state = cr.solve(codes, cr.START, list(cr.END))
        cost = int((cr.table(codes)[0] + np.array(cr.END)).min())
        assert (cost, letters + "I" * (cr.END[state] // cr.INSERT)) == brute_edits(codes.tolist())


def brute_repair(rows, every):
    """The contract, row by row."""
    space = " \t\n\x0b\x0c\r"
    held = {c: [] for c in every}
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        held[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = text.strip(space)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = "sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3
            codes.append(8 if fault in ("blank", "duplicate") else initial + 4 * (fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = {t for t, *_ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = brute_edits(codes)
        state, rest, lines = 0, iter(own), []
        for letter in audit:
            if letter == "I":
                state = cr.DUE[state]
                lines.append(f"{cr.NAMES[state]}:")
                continue
            _, role, text = next(rest)
            if letter == "R":
                state = cr.DUE[state]
                lines.append(f"{cr.NAMES[state]}:{text}")
            elif letter == "K":
                state = cr.NEXT[state]["sua".index(role[0])]
                lines.append(f"{role}:{text}")
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_conversations():
    rng = random.Random(9)
    out = []
    for conv in [None, *range(12)]:
        for turn in range(rng.choice([1, 2, 6, 30])):
            role = rng.choice(["user", "assistant", "assistant", "system", "tool", None, ""])
            out.append((conv, turn, role, rng.choice(["Yes.", "yes", "No! \n", "", None, " \t", f"text {turn}.", "漢字?", "x" * 100_000 + "."])))
    out += [(20, t // 2 * 3, "user" if t % 2 else "assistant", f"A {t}.") for t in range(400)]  # a long one, some turns repeated
    out += [(21, None, "user", "Same."), (21, None, "user", "Same."), (21, 4, "user", "Same."), (21, 4, "assistant", "Fine.")]
    out += [(22, 1, "user", "Hot.")] * 300 + [(22, t, "user", "Hot.") for t in range(2, 200)]
    return out


@pytest.mark.parametrize("piece", [65_536, 7])
def test_repair_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(cr, "PIECE", piece)
    rows = odd_conversations()
    given = spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], "conv_id bigint, turn bigint, role string, text string, kind string, copy string, audit string, no string")
    got = cr.repair(cr.damaged(given), given.select("conv_id"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repair(rows, dict.fromkeys(r[0] for r in rows))


def test_repair_of_no_rows(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    names = spark.createDataFrame([(5,), (None,)], "conv_id bigint")
    assert cr.repair(cr.damaged(none), none.select("conv_id")).collect() == []
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, cr.repair(none, names).collect()), key=repr) == [(5, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]
