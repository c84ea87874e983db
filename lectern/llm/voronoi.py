"""Exact top-k search as a Voronoi join of queries and rows.

The highest inner products are made the least distances: with M the greatest length of any row, a row x gets
one more component, the root of M² - |x|², and a query q gets a zero, so that the squared distance of the two
is |q|² + M² - 2 q·x. Then, for all queries at once:

1. Pivots are drawn from a bounded sample (SAMPLE rows, smoothed by a few rounds of k-means) and cut the space
   into cells. Each row belongs to the cell of its nearest pivot.
2. A summary of each cell is taken from all rows: how many there are and its k + 1 rows that lie nearest to the pivot.
3. Through the pivots these rows bound the distance of a query to its k-th neighbour: at most the k-th least of
   |query, pivot| + |pivot, row| over all summaries.
4. Queries are grouped by their cells, small cells with their neighbours and large ones in blocks. By the triangle
   inequality a query's neighbours in a cell lie in a range of distances from its pivot, and a cell wholly beyond
   the plane between the two pivots has none. The union of a group's ranges tells which rows of a cell the group needs.
5. A row goes only to the groups that need it, dealt over as many parts as they have rows for, so a cell that
   holds a third of all rows is the work of many tasks. Each part is searched exactly, and k rows for
   each query and part go on to the last choice.

No bound leaves out a neighbour, so the result is that of trying all pairs, whatever the pivots.

Rows with a null id or a vector that is null or has null or non-finite components take no part. Rows that share
a query's id are its own and no candidates; of several rows of a query's id the least vector is the query.
Other repeated rows each count. Ties go to the smaller id, shorter vectors end in zeros, and extra columns are
not looked at. No rows or no queries give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import durable
from lectern.llm.vectors import first_k, scores, usable, whole
from lectern.operators.blocks import WORK_ROWS, best_rows
from lectern.operators.lexical import top_k
from lectern.operators.sizes import small

#: Rows that the pivots are made of, how many pivots there are, and rounds of smoothing.
SAMPLE, PIVOTS, ROUNDS = 4_096, 64, 8
#: Queries of a group, and rows of a part.
GROUP_QUERIES, PART_ROWS = 1_024, 8_192
#: Share of the greatest length by which rounding may falsify a distance.
SLACK = 1e-6
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Space:
    """The pivots, in the space in which the nearest rows have the highest inner products."""

    def __init__(self, sample: np.ndarray, longest: float, pivots: int):
        self.square, self.width = longest, sample.shape[1]
        lifted = self.lift(sample)
        centres = lifted[:pivots].copy()
        for _ in range(ROUNDS):
            near = self._apart(lifted, centres).argmin(axis=1)
            for c in np.unique(near).tolist():
                centres[c] = lifted[near == c].mean(axis=0)
        self.pivots = np.unique(centres, axis=0)
        self.between = self._apart(self.pivots, self.pivots)
        self.slack = SLACK * (1 + np.sqrt(longest))

    @staticmethod
    def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
        return np.sqrt(np.maximum(square, 0))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x.astype(np.float64), ((0, 0), (0, max(0, self.width - x.shape[1]))))
        return np.column_stack([x, np.sqrt(np.maximum(0, self.square - (x**2).sum(axis=1)))])

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots."""
        return self._apart(self.lift(x), self.pivots)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = np.pad(q.astype(np.float64), ((0, 0), (0, self.width + 1 - q.shape[1])))
        return self._apart(q, self.pivots)


def cells(rows: DataFrame, space: Space, scale: int) -> DataFrame:
    """vec_id, embedding, cell and apart (the distance to its pivot); map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = space.of_rows(whole(batch["embedding"], scale))
            cell = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array(cell, pa.int32()), pa.array(apart[np.arange(len(cell)), cell], pa.float64())], names=["vec_id", "embedding", "cell", "apart"])

    return rows.mapInArrow(run, f"vec_id bigint, embedding {rows.schema['embedding'].dataType.simpleString()}, cell int, apart double")


def summaries(celled: DataFrame, k: int) -> tuple[pa.Table, pa.Table]:
    """(cell, n) of every cell, and (cell, vec_id, apart) of the k + 1 rows nearest to its pivot: at most PIVOTS times as many rows."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) > 50_000:
                held = [of_each(pa.concat_tables(held))]
        if held:
            yield from of_each(pa.concat_tables(held)).combine_chunks().to_batches()

    def of_each(t: pa.Table) -> pa.Table:
        once = t.group_by(["cell", "vec_id"]).aggregate([("apart", "min")]).rename_columns(["cell", "vec_id", "apart"])
        near = best_rows(once.append_column("close", pa.array(-once["apart"].to_numpy())), k + 1, ["cell"], "close", "vec_id")
        return near.select(["cell", "vec_id", "apart"])

    narrow = celled.select("cell", "vec_id", "apart")
    near = narrow.mapInArrow(nearest, "cell int, vec_id bigint, apart double").groupBy("cell", "vec_id").agg(F.min("apart").alias("apart"))
    return celled.groupBy("cell").agg(F.count("*").alias("n")).toArrow(), top_k(near, k + 1, "cell", [F.col("apart"), F.col("vec_id")]).drop("rank").toArrow()


def bound(apart: np.ndarray, ids: np.ndarray, near: pa.Table, k: int) -> np.ndarray:
    """For each query, with its distances to the pivots, how far away its k-th neighbour is at most."""
    item, to_pivot = near["vec_id"].to_numpy(), near["apart"].to_numpy()
    reach = apart[:, near["cell"].to_numpy()] + to_pivot[None, :]
    reach[ids[:, None] == item[None, :]] = np.inf
    # A row may be the nearest of one cell only, and another row of the same id of another: both are rows.
    return np.partition(reach, k - 1, axis=1)[:, k - 1] if reach.shape[1] >= k else np.full(len(ids), np.inf)


def groups(counts: dict[int, int], space: Space, most: int) -> dict[int, tuple[int, int]]:
    """For each cell with queries its first group and in how many groups it is split. Small neighbouring cells share one."""
    left, at, order = set(counts), min(counts, default=0), []
    while left:
        at = min(left, key=lambda c: (space.between[at, c], c))
        left.remove(at)
        order.append(at)
    out, group, held = {}, 0, 0
    for c in order:
        if held and held + counts[c] > most:
            group, held = group + 1, 0
        n = -(-counts[c] // most)
        out[c] = (group, n)
        held += counts[c]
        if n > 1:
            group, held = group + n, 0
    return out


def _solve(held: pa.Table, wanted: pa.Table, space: Space, scale: int, k: int) -> pa.Table:
    """The k best rows of a part for each query of a group; a cell's rows are tried by the queries whose range they meet."""
    out = []
    if held.num_rows and wanted.num_rows:
        held = held.sort_by([("cell", "ascending"), ("vec_id", "ascending")])
        ids, q = wanted["query_id"].to_numpy(), whole(wanted["embedding"], scale)
        theta, reach = wanted["theta"].to_numpy(), space.of_queries(q)
        cell, apart, item = held["cell"].to_numpy(), held["apart"].to_numpy(), held["vec_id"].to_numpy()
        x = whole(held["embedding"], scale)
        x, q = (np.pad(m, ((0, 0), (0, max(x.shape[1], q.shape[1]) - m.shape[1]))) for m in (x, q))
        cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        for start, stop in zip(cuts, [*cuts[1:], len(cell)], strict=True):
            for a in range(start, stop, WORK_ROWS):
                b = min(a + WORK_ROWS, stop)
                near = reach[:, cell[a]]
                j = np.flatnonzero((near - theta <= apart[a:b].max() + space.slack) & (near + theta >= apart[a:b].min() - space.slack))
                if len(j):
                    found = scores(x[a:b], q[j])
                    row, column = first_k(found, item[a:b, None] != ids[None, j], k)
                    out.append(pa.table([ids[j[column]], item[a + row], found[row, column]], schema=FOUND))
    return best_rows(pa.concat_tables(out), k, ["query_id"], "score", "vec_id") if out else FOUND.empty_table()


def top_scores(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, pivots: int = PIVOTS, group: int = GROUP_QUERIES, part: int = PART_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows of the highest inner product for each query.

    vectors: vec_id, embedding; `is_query` tells by vec_id which rows are queries. Components count as floor(scale * x).
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter("vec_id is not null").filter(usable("embedding"))
    spark = rows.sparkSession
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), 2))
    longest, width = rows.agg(F.coalesce(F.max(squares), F.lit(0.0)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    drawn = whole(sample["embedding"], scale)
    space = Space(np.pad(drawn, ((0, 0), (0, width - drawn.shape[1]))), longest, pivots)
    celled = cells(rows, space, scale)
    counted, near = summaries(celled, k)

    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumnRenamed("vec_id", "query_id")
    kind = rows.schema["embedding"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = space.of_queries(whole(batch["embedding"], scale))
            theta = bound(apart, batch["query_id"].to_numpy(), near, k) + space.slack
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["embedding"], pa.array(theta), pa.array(apart.argmin(axis=1), pa.int32())], names=["query_id", "embedding", "theta", "cell"])

    measured = durable(asked.mapInArrow(measure, f"query_id bigint, embedding {kind}, theta double, cell int"))
    dealt = groups({r["cell"]: r["n"] for r in measured.groupBy("cell").agg(F.count("*").alias("n")).collect()}, space, group)
    if not dealt:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    first = F.element_at(F.create_map(*[F.lit(v) for c, (g, _) in dealt.items() for v in (c, g)]), F.col("cell"))
    split = F.element_at(F.create_map(*[F.lit(v) for c, (_, n) in dealt.items() for v in (c, n)]), F.col("cell"))
    grouped = measured.withColumn("group", (first + F.pmod(F.xxhash64("query_id"), split)).cast("int"))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, theta, number = (batch[c].to_numpy() for c in ("cell", "theta", "group"))
            apart = space.of_queries(whole(batch["embedding"], scale))
            low, high = apart - theta[:, None], apart + theta[:, None]
            # Beyond the plane between its own pivot and another one the distance is at least this.
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.nan_to_num((apart**2 - (apart[np.arange(len(own)), own] ** 2)[:, None]) / (2 * space.between[own]), nan=0, posinf=0, neginf=0)
            out = plane > theta[:, None] + space.slack
            low[out], high[out] = np.inf, -np.inf
            for g in np.unique(number).tolist():
                least, most = low[number == g].min(axis=0), high[number == g].max(axis=0)
                c = np.flatnonzero(least <= most)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), g), pa.int32()), pa.array(c, pa.int32()), pa.array(least[c]), pa.array(most[c])], names=["group", "cell", "low", "high"])

    needed = durable(grouped.mapInArrow(ranges, "group int, cell int, low double, high double").groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    sizes = spark.createDataFrame(counted.to_pandas(), "cell int, n bigint")  # a row for each pivot
    parts = needed.join(F.broadcast(sizes), "cell").groupBy("group").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / part)).cast("int").alias("parts"))
    routes = needed.join(parts, "group")
    close = (F.col("apart") >= F.col("low") - space.slack) & (F.col("apart") <= F.col("high") + space.slack)
    sent = celled.join(small(routes), "cell").filter(close).select("vec_id", "embedding", "cell", "apart", "group", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"))
    met = grouped.join(small(parts), "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("query_id", "embedding", "theta", "group", "part")
    found = sent.groupBy("group", "part").cogroup(met.groupBy("group", "part")).applyInArrow(lambda held, wanted: _solve(held, wanted, space, scale, k), "query_id bigint, vec_id bigint, score bigint")
    return top_k(found, k, "query_id", [F.desc("score"), F.col("vec_id")]).select("query_id", "rank", "vec_id", "score")
