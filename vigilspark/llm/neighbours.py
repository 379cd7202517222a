"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are cut into bands of similar length. Within a band they are scaled by its
longest one and get one extra coordinate that makes all of them equally long, which
turns the largest inner product with a query of unit length into the least distance.
A band that cannot beat what a query has found in longer ones is left out for it, by
the exact bound on inner products. A few Gaussian projections
keep distances up to a chi-square factor: the squared projected distance over
the squared true one follows a chi-square law with as many degrees of freedom.
A kd-tree over the projections gives candidates in rising projected distance;
a search ends when a point not yet seen, at the projected distance reached,
would be nearer than the current k-th neighbour only with small probability.

The upper tree is fitted on a bounded sample and names the cells that rows are
dealt to; each cell builds its lower tree when it is searched. A query first
searches its own cell, then every other cell whose box passes the same test.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import arrow_map, prepare

#: Projections (even, so that the chi-square law has a closed form) and the probability that ends a search.
DIMENSIONS = 8
STOP = 0.85
#: Rows that the upper tree is fitted on, at most; rows of one cell on average; rows of one leaf.
FIT_ROWS = 20_000
CELL_ROWS = 4_096
LEAF_ROWS = 64
#: Cells of the upper tree at most; a larger cell is searched in hash slices of it.
MAX_CELLS = 4_096
#: Queries that one task searches in one cell, and those that go side by side.
QUERY_ROWS, QUERY_BLOCK = 8_192, 256


def chi_square(x: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """P(X <= x) of a chi-square law with an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dimensions // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def projection(width: int, dimensions: int = DIMENSIONS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, dimensions))


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors of length one at most with the coordinate that makes their length one."""
    return np.column_stack([x, np.sqrt(np.maximum(1.0 - (x * x).sum(axis=1), 0.0))])


def log_lengths(x: np.ndarray) -> np.ndarray:
    """Binary logarithms of lengths; neither squares nor lengths can overflow or vanish on the way."""
    top = np.abs(x).max(axis=1)
    return np.log2(top) + 0.5 * np.log2(np.square(x / top[:, None]).sum(axis=1))


def shrunk(x: np.ndarray, log: np.ndarray | float) -> np.ndarray:
    """``x`` divided by two to the power ``log`` (one number, or one per row)."""
    whole = np.floor(log)
    out = np.ldexp(x.T, -whole.astype(int) if isinstance(whole, np.ndarray) else -int(whole))
    return (out / np.exp2(log - whole)).T


def length_bands(octaves: list[tuple[int, int]], share: float = 1 / 16) -> list[tuple[int, int]]:
    """First and last octave of each band, from the number of points per octave below the longest point.

    A new band starts at every octave with a considerable share of the points, so a few much
    longer points are a band of their own and do not loosen the test for the others.
    """
    total, bands = sum(n for _, n in octaves), []
    for octave, n in sorted(octaves):
        if not bands or n >= share * total:
            bands.append((octave, octave))
        else:
            bands[-1] = (bands[-1][0], octave)
    return bands


class Splits:
    """The upper tree: heap-ordered splits, 2^depth cells, and the box of each cell."""

    def __init__(self, points: np.ndarray, cells: int):
        self.depth = max(0, math.ceil(math.log2(max(1, cells))))
        size = 1 << self.depth
        width = points.shape[1]
        self.axis = np.zeros(size, np.int64)
        self.value = np.zeros(size)
        self.low = np.full((2 * size, width), -np.inf)
        self.high = np.full((2 * size, width), np.inf)
        held = {1: points}
        for node in range(1, size):
            inside = held.pop(node)
            axis = int(np.argmax(np.ptp(inside, axis=0))) if len(inside) else 0
            value = float(np.median(inside[:, axis])) if len(inside) else 0.0
            self.axis[node], self.value[node] = axis, value
            right = inside[:, axis] > value
            held[2 * node], held[2 * node + 1] = inside[~right], inside[right]
            for side in (0, 1):
                self.low[2 * node + side], self.high[2 * node + side] = self.low[node], self.high[node]
            self.high[2 * node, axis] = value
            self.low[2 * node + 1, axis] = value
        self.low, self.high = self.low[size:], self.high[size:]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - (1 << self.depth)

    def gaps(self, points: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell's box."""
        return box_gaps(points, self.low, self.high)


def box_gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        off = np.maximum(low[None, :, j] - points[:, None, j], points[:, None, j] - high[None, :, j])
        out += np.square(np.maximum(off, 0.0))
    return out


class Leaves:
    """The lower tree of one cell, as leaves with tight boxes."""

    def __init__(self, points: np.ndarray, size: int = LEAF_ROWS):
        parts, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= size:
                parts.append(rows)
                continue
            axis = int(np.argmax(np.ptp(points[rows], axis=0)))
            half = len(rows) // 2
            order = np.argpartition(points[rows, axis], half)
            todo += [rows[order[:half]], rows[order[half:]]]
        self.rows = parts
        self.low = np.array([points[r].min(axis=0) for r in parts])
        self.high = np.array([points[r].max(axis=0) for r in parts])


def search(
    queries: np.ndarray, projected: np.ndarray, leaves: Leaves, vectors: np.ndarray, log: np.ndarray, k: int,
    stop: float, floor: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best inner products, row numbers (-1: none) and leaves visited of each query; best first, ties to the earlier row.

    Leaf by leaf in rising projected distance, all queries of the block side by
    side; a query leaves when the chi-square test holds at its next leaf. ``log`` is the
    logarithm of the query's length times that of the longest vector, by which products are
    measured in the test; ``floor`` is what the k-th product is known to reach elsewhere.
    """
    best = np.full((len(queries), k), -np.inf)
    names = np.full((len(queries), k), -1, np.int64)
    visited = np.zeros(len(queries), np.int64)
    gaps = box_gaps(projected, leaves.low, leaves.high)
    order = np.argsort(gaps, axis=1, kind="stable")
    alive = np.arange(len(queries))
    for turn in range(order.shape[1]):
        leaf = order[alive, turn]
        reach = 2.0 - 2.0 * shrunk(np.maximum(best[alive, -1], floor[alive]), log[alive])
        going = chi_square(gaps[alive, leaf] / np.maximum(reach, 1e-12)) < stop
        alive, leaf = alive[going], leaf[going]
        if not len(alive):
            break
        visited[alive] += 1
        for one in np.unique(leaf):
            who, rows = alive[leaf == one], leaves.rows[one]
            # One fixed order of summation, so that equal vectors have equal products.
            with np.errstate(over="ignore", invalid="ignore"):
                score = (queries[who][:, None, :] * vectors[rows][None, :, :]).sum(axis=2)
            score = np.concatenate([best[who], np.where(np.isnan(score), -np.inf, score)], axis=1)
            name = np.concatenate([names[who], np.broadcast_to(rows, (len(who), len(rows)))], axis=1)
            take = np.lexsort((name, -score), axis=1)[:, :k]
            best[who] = np.take_along_axis(score, take, axis=1)
            names[who] = np.take_along_axis(name, take, axis=1)
    return best, names, visited


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with a finite vector of some length above zero, in double precision."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter("v is not null and vec_id is not null").filter(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    )


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, stop: float = STOP, fit_rows: int = FIT_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product for each query row.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; a row is no
    neighbour of itself. Vectors that are null, all zero, or hold a null or
    non-finite component take no part, and vectors of different widths do not meet.
    Equal vectors are indexed once, with their ``k + 1`` least ids, which is all that
    any query can return of them; so a vector that a third of all rows share is one
    point. Rows of a repeated ``vec_id`` count as one neighbour when their vectors are
    equal. Products beyond the range of doubles are infinite, those of no defined sign come last.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    rows = usable(vectors).withColumn("d", F.size("v")).withColumn("key", F.xxhash64("v"))
    # Ranks by (key, vector): Spark cuts each group to k + 1 rows before the shuffle.
    least = W.partitionBy("key", "v").orderBy("vec_id")
    members = rows.distinct().withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= k + 1)
    points = written(
        members.groupBy("key", "v").agg(F.max("d").alias("d"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "points"
    ).withColumn("uid", F.monotonically_increasing_id())
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    squares = F.aggregate(F.transform("v", lambda x: x / F.col("top")), F.lit(0.0), lambda a, x: a + x * x)
    points = points.withColumn("top", top).withColumn("log", F.log2("top") + 0.5 * F.log2(squares)).drop("top")
    points = written(points, "points")
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "key", "v").distinct()
    asked = written(asked.join(points.select("key", "v", "uid", "d"), ["key", "v"]).select("vec_id", "uid", "d", "v"), "queries")

    outs = []
    for width, longest in points.groupBy("d").agg(F.max("log")).collect():
        of_width = points.filter(F.col("d") == width).withColumn("octave", F.floor(F.lit(longest) - F.col("log")).cast("int"))
        outs.append(_of_width(of_width, asked.filter(F.col("d") == width), width, k, stop, fit_rows, cell_rows))
    if not outs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = outs[0]
    for frame in outs[1:]:
        out = out.unionByName(frame)
    return out


FOUND = "uid long, vec_id long, score double"


def _of_width(points, asked, width, k, stop, fit_rows, cell_rows):
    # One search per distinct vector asked; the reader's own row is taken out at the end.
    distinct = asked.select("uid", "v").dropDuplicates(["uid"])
    # There are about two thousand octaves in double precision.
    octaves = {r["octave"]: r for r in points.groupBy("octave").agg(F.count("*").alias("n"), F.max("log").alias("log")).collect()}
    by = W.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    found = None
    for first, last in length_bands([(o, r["n"]) for o, r in octaves.items()]):
        inside = [r for o, r in octaves.items() if first <= o <= last]
        band = points.filter(F.col("octave").between(first, last))
        new = _search_band(band, distinct, found, width, max(r["log"] for r in inside), sum(r["n"] for r in inside),
                           k, stop, fit_rows, cell_rows)
        both = new if found is None else found.unionByName(new)
        found = written(both.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k + 1).drop("_r"), "found")
    own = asked.select(F.col("vec_id").alias("query_id"), "uid").join(found, "uid").filter("query_id != vec_id")
    place = W.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _with_floor(queries, found, k):
    """Queries with their k-th best product so far, null while there are fewer; one more counts for the query's own row."""
    if found is None:
        return queries.withColumn("floor", F.lit(None).cast("double"))
    floors = found.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("m"))
    floors = floors.select("uid", F.when(F.col("n") > k, F.col("m")).alias("floor"))
    return queries.join(floors, "uid", "left").select("uid", "v", "floor")


def _search_band(points, queries, found, width, log, number, k, stop, fit_rows, cell_rows):
    direction = projection(width + 1)

    def matrix(vectors) -> np.ndarray:
        return np.array(vectors, float).reshape(len(vectors), width)

    def project(batches):
        for batch in batches:
            v = batch["v"].to_pylist()
            yield {"uid": batch["uid"], "p": list(lifted(shrunk(matrix(v), log)) @ direction) if v else []}

    # The sample reaches the driver as projected points of a few numbers.
    sample = arrow_map(points.select("uid", "v"), "uid long, p array<double>", project)
    sample = sample.orderBy(F.xxhash64("uid")).limit(fit_rows).select("p").collect()
    tree = Splits(np.array([r["p"] for r in sample]).reshape(len(sample), DIMENSIONS), min(MAX_CELLS, max(1, number // cell_rows)))

    def deal(batches):
        for batch in batches:
            v = batch["v"].to_pylist()
            yield {"cell": tree.cell(lifted(shrunk(matrix(v), log)) @ direction) if v else [], "uid": batch["uid"], "v": batch["v"], "ids": batch["ids"]}

    placed = written(arrow_map(points.select("uid", "v", "ids"), "cell long, uid long, v array<double>, ids array<long>", deal), "cells")

    def visit(batches, home: bool):
        # The lifted query has a zero last coordinate: its distance falls as the inner product rises.
        for batch in batches:
            v, uid = batch["v"].to_pylist(), batch["uid"].to_numpy()
            if not v:
                continue
            x = matrix(v)
            lengths = log_lengths(x)
            projected = np.column_stack([shrunk(x, lengths), np.zeros(len(x))]) @ direction
            own = tree.cell(projected)
            floor = np.array([f if f is not None else -np.inf for f in batch["floor"].to_pylist()])
            level = shrunk(floor, lengths + log)
            # No product with this band exceeds the lengths' product, which is level 1.
            within = level <= 1 + 1e-9
            if home:
                query = np.flatnonzero(within)
                cell = own[query]
            else:
                go = chi_square(tree.gaps(projected) / np.maximum(2.0 - 2.0 * level, 1e-12)[:, None]) < stop
                go[np.arange(len(x)), own] = False
                query, cell = np.nonzero(go & within[:, None])
            yield {"cell": cell, "uid": uid[query], "v": [v[i] for i in query], "floor": [None if f == -np.inf else f for f in floor[query]]}

    schema = "cell long, uid long, v array<double>, floor double"

    def searched(visits: DataFrame) -> DataFrame:
        return _search_cells(placed, written(visits, "visits"), log, direction, k, stop, cell_rows)

    first = written(searched(arrow_map(_with_floor(queries, found, k), schema, lambda b: visit(b, True))), "found")
    # The k-th best product so far is what another cell must be able to beat.
    sofar = first if found is None else found.unionByName(first)
    by = W.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    sofar = sofar.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k + 1).drop("_r")
    second = searched(arrow_map(_with_floor(queries, sofar, k), schema, lambda b: visit(b, False)))
    return first.unionByName(second)


def _search_cells(placed, visits, log, direction, k, stop, cell_rows):
    """``uid, vec_id, score``: what each visit finds in its cell.

    A cell of more than twice ``cell_rows`` points is cut into slices, and its
    visits into groups of ``QUERY_ROWS`` at most on average; every (slice, group)
    is one task of bounded size and none is skipped.
    """
    points = placed.groupBy("cell").agg(F.count("*").alias("p"))
    sizes = visits.groupBy("cell").agg(F.count("*").alias("q")).join(points, "cell").select(
        "cell", F.ceil(F.col("p") / (2 * cell_rows)).cast("int").alias("slices"),
        F.ceil(F.col("q") / QUERY_ROWS).cast("int").alias("groups"),
    )
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    left = placed.join(sizes, "cell").select("cell", spread("slices").alias("slice"), each("groups").alias("grp"), "uid", "v", "ids")
    right = visits.join(sizes, "cell").select("cell", each("slices").alias("slice"), spread("groups").alias("grp"), "uid", "v", "floor")

    def run(points_frame: pd.DataFrame, query_frame: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"uid": [], "vec_id": [], "score": []}).astype({"uid": "int64", "vec_id": "int64"})
        if not len(points_frame) or not len(query_frame):
            return empty
        points_frame = points_frame.assign(first=[i[0] for i in points_frame["ids"]]).sort_values("first", kind="stable")
        vectors = np.stack(points_frame["v"].to_numpy()).astype(float)
        ids = points_frame["ids"].tolist()
        leaves = Leaves(lifted(shrunk(vectors, log)) @ direction)
        uid = query_frame["uid"].to_numpy()
        x = np.stack(query_frame["v"].to_numpy()).astype(float)
        floor = np.nan_to_num(query_frame["floor"].to_numpy(float), nan=-np.inf, neginf=-np.inf)
        lengths = log_lengths(x)
        projected = np.column_stack([shrunk(x, lengths), np.zeros(len(x))]) @ direction
        out = []
        for at in range(0, len(x), QUERY_BLOCK):
            some = slice(at, at + QUERY_BLOCK)
            best, names, _ = search(x[some], projected[some], leaves, vectors, lengths[some] + log, k + 1, stop, floor[some])
            for q, scores, rows in zip(uid[some], best, names):
                out += [(q, i, score) for score, row in zip(scores, rows) if row >= 0 for i in ids[row]]
        return pd.DataFrame(out, columns=["uid", "vec_id", "score"]) if out else empty

    keys = ["cell", "slice", "grp"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, FOUND)
