"""Exact top-k inner-product search as a Voronoi kNN join.

Largest inner products are nearest neighbours once every vector x gets one more
component, sqrt(M*M - x.x) for rows (M: the longest norm) and 0 for queries.
Rows and queries are grouped by their nearest pivot; pivots grow with the
square root of the rows.  A summary per cell (its rows' least and largest
distance from the pivot, and the k + 1 least) gives each query an upper bound
of the distance to its k-th neighbour, and by the triangle inequality the ring
around each pivot in which rows can matter.  Rows lie in blocks of neighbouring
cells: a query is sent only to blocks with a cell whose rows reach its ring, and
a row only to the parts of queries with a ring that holds it.  Each block is
solved by a matrix product, and the blocks' winners are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.session import stage

#: documented bounds: pivots (a sample by hash; the square root of the rows up to this), queries of a group's part, rows of a block
PIVOTS, FEW_PIVOTS = 2048, 16
QUERY_BLOCK = 4096
ROW_BLOCK = 8192
_EXACT = 2.0**53


def whole_vector(column: str) -> Column:
    """Neither null nor holding null or non-finite components."""
    return F.col(column).isNotNull() & F.forall(
        column, lambda x: F.coalesce((F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x.cast("double")), F.lit(False)))


def floored(rows: DataFrame, id_col: str, column: str, factor: int = 64) -> DataFrame:
    """vec_id and z, the vector of floor(factor * x), of the rows that take part; a repeated vec_id counts once, with its least vector."""
    rows = rows.filter(F.col(id_col).isNotNull() & whole_vector(column)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(column, lambda x: x.cast("double")).alias("x"))
    rows = rows.groupBy("vec_id").agg(F.min("x").alias("x"))

    def run(batches):
        for batch in batches:
            x = batch.column("x")
            z = pa.ListArray.from_arrays(x.offsets, pa.array(np.floor(factor * x.values.to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), z], names=["vec_id", "z"])

    return rows.mapInArrow(run, "vec_id long, z array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    if len(flat):
        row = np.repeat(np.arange(len(column)), at)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(at) - at, at)] = flat
    return out


@dataclass
class Plan:
    """What every task needs to know: pivots in the wider space, summaries of cells, and the blocks of each cell."""

    pivots: np.ndarray
    longest: float  # squared norm
    width: int
    inner: np.ndarray | None = None  # least and largest distance of a cell's rows from its pivot
    outer: np.ndarray | None = None
    near: np.ndarray | None = None  # cell x (k + 1) least distances, filled up with infinity
    k: int = 0
    block: np.ndarray | None = None  # first block of each cell, and how many it has
    blocks: np.ndarray | None = None

    def widen(self, z: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(z)) if query else np.sqrt(np.maximum(0, self.longest - (z * z).sum(axis=1)))
        return np.column_stack([z, extra])

    def nearest(self, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = (wide * wide).sum(axis=1)[:, None] - 2 * wide @ self.pivots.T + (self.pivots**2).sum(axis=1)
        cell = square.argmin(axis=1)
        return cell, np.sqrt(((wide - self.pivots[cell]) ** 2).sum(axis=1))

    def rings(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query and cell: the distances from the pivot between which a row can be among the query's k nearest."""
        low, high = np.empty((len(z), len(self.pivots))), np.empty((len(z), len(self.pivots)))
        if self.longest >= _EXACT:  # scores are cut to 64 bits there, so that rows of unequal distance can tie
            return np.full_like(low, -np.inf), np.full_like(high, np.inf)
        for at in range(0, len(z), 64):
            q = self.widen(z[at:at + 64], True)
            far = np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] - 2 * q @ self.pivots.T + (self.pivots**2).sum(axis=1)))
            reach = (far[:, :, None] + self.near).reshape(len(q), -1)  # k + 1 rows, since one may be the query's own
            upper = np.partition(reach, self.k, axis=1)[:, self.k] if reach.shape[1] > self.k else np.full(len(q), np.inf)
            upper = (upper + 1e-6 * (1 + np.where(np.isfinite(upper), upper, 0) + far.max(axis=1)))[:, None]
            low[at:at + 64], high[at:at + 64] = far - upper, far + upper
        return low, high

    def reached(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether some row of a cell lies in the ring."""
        return (self.outer >= low) & (self.inner <= high)


def _assign(plan: Plan, query: bool):
    def run(batches):
        for batch in batches:
            cell, far = plan.nearest(plan.widen(_matrix(batch.column("z"), plan.width), query)) if len(batch) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    return run


def _summaries(plan: Plan, cells: DataFrame, k: int) -> np.ndarray:
    """Fill in the summaries of cells; the rows of each cell are returned."""
    n = len(plan.pivots)
    plan.k, plan.near = k, np.full((n, k + 1), np.inf)
    plan.inner, plan.outer, rows = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
    for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("inner"), F.max("far").alias("outer")).collect():  # at most PIVOTS rows
        rows[r["cell"]], plan.inner[r["cell"]], plan.outer[r["cell"]] = r["n"], r["inner"], r["outer"]
    order = Window.partitionBy("cell").orderBy("far", "vec_id")
    near = cells.select("cell", "far", "vec_id").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    for r in near.select("cell", "far", "r").collect():  # at most PIVOTS * (k + 1) rows
        plan.near[r["cell"], r["r"] - 1] = r["far"]
    return rows


def _runs(plan: Plan, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First run and number of runs of each cell: small neighbouring cells share a run, a large one is split."""
    first, runs, run, filled = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most)), 0, 0
    for cell in np.lexsort(plan.pivots.T[::-1]):
        if filled and filled + sizes[cell] > most:
            run, filled = run + 1, 0
        first[cell] = run
        filled += sizes[cell]
        if runs[cell] > 1:
            run, filled = run + runs[cell], 0
    return first, runs


def _asked(plan: Plan):
    """The blocks that hold a cell which a query reaches."""

    def run(batches):
        for batch in batches:
            reached = plan.reached(*plan.rings(_matrix(batch.column("z"), plan.width)))
            blocks = [np.unique(np.concatenate([np.arange(plan.block[c], plan.block[c] + plan.blocks[c]) for c in np.flatnonzero(r)] or [np.zeros(0, np.int64)]))
                      for r in reached]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "vec_id", "z")), pa.array(blocks, pa.list_(pa.int64()))],
                                             names=["part", "vec_id", "z", "blocks"])

    return run


def _wanted(plan: Plan):
    """Per part of queries and cell: the ring that holds the rings of the queries which reach the cell."""

    def run(batches):
        for batch in batches:
            part = batch.column("part").to_numpy()
            low, high = plan.rings(_matrix(batch.column("z"), plan.width))
            reached = plan.reached(low, high)
            for p in np.unique(part):
                mine = reached & (part == p)[:, None]
                cell = np.flatnonzero(mine.any(axis=0))
                least, most = np.where(mine, low, np.inf).min(axis=0), np.where(mine, high, -np.inf).max(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), p)), pa.array(cell.astype(np.int32)), pa.array(least[cell]), pa.array(most[cell])],
                                                 names=["part", "cell", "low", "high"])

    return run


def _solve(plan: Plan, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if len(left) and len(right):
            right = right.take(pa.array(np.argsort(right.column("vec_id").to_numpy(), kind="stable")))
            ids, rows = right.column("vec_id").to_numpy(), _matrix(right.column("z"), plan.width)
            queries, own = _matrix(left.column("z"), plan.width), left.column("vec_id").to_numpy()
            exact = plan.longest < _EXACT
            for at in range(0, len(queries), 256):
                some = slice(at, at + 256)
                if exact:
                    score = queries[some] @ rows.T
                else:  # beyond doubles: whole numbers of any size, cut to 64 bits
                    whole = np.array([[int(x) for x in r] for r in queries[some]], object) @ np.array([[int(x) for x in r] for r in rows], object).T
                    score = np.clip(whole, -(2**63), 2**63 - 1)
                for i, q in enumerate(own[some]):
                    mine = np.flatnonzero(ids != q)
                    s = score[i, mine]
                    if len(s) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k] if exact else sorted(s)[len(s) - k]
                        mine, s = mine[s >= edge], s[s >= edge]
                    best = np.argsort(-s, kind="stable")[:k]  # rows come by vec_id
                    out_q.append(np.full(len(best), q))
                    out_v.append(ids[mine[best]])
                    out_s.append(s[best].astype(np.int64))
        empty = [np.zeros(0, np.int64)]
        return pa.table({"query_id": np.concatenate(out_q or empty), "vec_id": np.concatenate(out_v or empty), "score": np.concatenate(out_s or empty)})

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows of largest inner product with each query.

    ``queries`` and ``rows`` have vec_id and z (whole numbers as doubles), each
    vec_id once; a query's own vec_id is no candidate.  Ties go to the smaller
    vec_id.  Fewer than k candidates are all returned; a query without
    candidates, and empty tables, give no rows.  Shorter vectors count as
    filled with zeros.  Scores beyond 64 bits are cut to them.
    """
    spark = rows.sparkSession
    dealt = deal(queries, rows, k)
    if dealt is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    plan, asked, sent = dealt
    found = asked.groupBy("part", "block").cogroup(sent.groupBy("part", "block")).applyInArrow(
        _solve(plan, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def deal(queries: DataFrame, rows: DataFrame, k: int) -> tuple[Plan, DataFrame, DataFrame] | None:
    """The queries of each (part, block) and the rows of each; None without queries or rows."""
    rows = stage(rows, "vectors")
    square = F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x)
    facts, most = (x.agg(F.count("*").alias("n"), F.max(square).alias("longest"), F.max(F.size("z")).alias("width")).first() for x in (rows, queries))
    if not facts["n"] or not most["n"]:
        return None
    width = max(facts["width"], most["width"], 1)
    n_pivots = min(PIVOTS, max(FEW_PIVOTS, int(facts["n"] ** 0.5)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()  # a bounded sample
    pivots = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        pivots[i, :len(r["z"])] = r["z"]
    plan = Plan(np.zeros((0, 0)), max(facts["longest"], most["longest"]), width)
    plan.pivots = np.unique(plan.widen(pivots, False), axis=0)

    schema = "vec_id long, z array<double>, cell int, far double"
    cells = stage(rows.mapInArrow(_assign(plan, False), schema), "cells")
    groups = stage(queries.select("vec_id", "z").mapInArrow(_assign(plan, True), schema), "groups")
    plan.block, plan.blocks = _runs(plan, _summaries(plan, cells, k), ROW_BLOCK)
    sizes = np.zeros(len(plan.pivots), np.int64)
    for r in groups.groupBy("cell").count().collect():  # at most PIVOTS rows
        sizes[r["cell"]] = r["count"]

    def dealt(df: DataFrame, name: str, first: np.ndarray, runs: np.ndarray) -> DataFrame:
        """Each vector's run; a cell's runs are chosen by hash."""
        of = df.sparkSession.createDataFrame([(c, int(f), int(r)) for c, (f, r) in enumerate(zip(first, runs))], "cell int, first long, runs long")
        return df.join(of, "cell").withColumn(name, F.col("first") + F.pmod(F.xxhash64("vec_id"), "runs")).drop("first", "runs")

    groups = dealt(groups, "part", *_runs(plan, sizes, QUERY_BLOCK))
    asked = groups.mapInArrow(_asked(plan), "part long, vec_id long, z array<double>, blocks array<long>").select(
        "part", F.explode("blocks").alias("block"), "vec_id", "z")
    wanted = groups.mapInArrow(_wanted(plan), "part long, cell int, low double, high double").groupBy("part", "cell").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    sent = dealt(cells, "block", plan.block, plan.blocks).join(wanted, "cell").filter("far >= low and far <= high").select("part", "block", "vec_id", "z")
    return plan, asked, sent
