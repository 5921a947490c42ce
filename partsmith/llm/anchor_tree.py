"""Hard negatives by bounds along spanning trees of anchors.

Anchors are dealt to parts of similar ones (signs of random projections); each
part meets the rows in blocks.  In a part the anchors are joined by a minimum
spanning tree.  The root's inner products with a block are computed; for a
child anchor, an inner product lies within that of its parent plus or minus
the length of the edge times the norm of the row.  Only rows whose interval
overlaps what the child looks for (its best rows of the same label, or the
window of scores set by its positives) are scored anew, and hand exact scores
down; the others hand down their intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.session import stage

#: anchors of a part (a tree) and rows of a block, on average
ANCHOR_BLOCK = 512
ROW_BLOCK = 8192
#: numbers beyond this are cut to it, so that a hundred times the inner product of up to 5,000 components stays in 64 bits
_MOST = 2**22
_EXACT = 2.0**52
_ANCHOR = ["anchor_id", "print"]


def whole_rows(rows: DataFrame, factor: int) -> DataFrame:
    """vec_id, label and z = floor(factor * x) of the rows with id, label and vector, all components finite; repeated rows stay."""
    def finite(x: Column) -> Column:
        return F.coalesce((F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x.cast("double")), F.lit(False))

    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    z = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * factor, F.lit(float(_MOST))), F.lit(float(-_MOST)))).cast("int"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), z.alias("z"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    if len(flat):
        out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def spanning_tree(points: np.ndarray) -> list[tuple[int, int, float]]:
    """(node, parent, length of the edge) of a minimum spanning tree, parents first; the root is its own parent."""
    square = (points**2).sum(axis=1)
    far = np.sqrt(np.maximum(0, square[:, None] - 2 * points @ points.T + square[None]))
    n = len(points)
    root = int(far.sum(axis=1).argmin())
    best, parent = far[root].copy(), np.full(n, root)
    inside = np.zeros(n, bool)
    inside[root] = True
    out = [(root, root, 0.0)]
    for _ in range(n - 1):
        node = int(np.where(inside, np.inf, best).argmin())
        inside[node] = True
        out.append((node, int(parent[node]), float(np.linalg.norm(points[node] - points[parent[node]]))))
        closer = far[node] < best
        best[closer], parent[closer] = far[node][closer], node
    return out


class Block:
    """Rows of a block: exact inner products, and bounds of those of each anchor of a tree in turn."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.norm = np.sqrt((rows**2).sum(axis=1))
        self.scored = 0

    def score(self, anchor: np.ndarray, use: np.ndarray) -> np.ndarray:
        self.scored += len(use)
        rows = self.rows if len(use) == len(self.rows) else self.rows[use]
        if np.linalg.norm(anchor) * (self.norm.max() if len(use) else 0) < _EXACT:
            return (rows @ anchor).astype(np.int64)
        return rows.astype(np.int64) @ anchor.astype(np.int64)

    def walk(self, anchors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Anchor, lower and upper bounds per row; the caller writes exact scores into both before it goes on."""
        tree = spanning_tree(anchors)
        children = np.bincount([p for v, p, _ in tree if v != p], minlength=len(anchors))
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for node, parent, edge in tree:
            if node == parent:
                low = self.score(anchors[node], np.arange(len(self.rows))).astype(float)
                high = low.copy()
            else:
                reach = edge * self.norm * (1 + 1e-9) + 1e-3
                low, high = known[parent][0] - reach, known[parent][1] + reach
                children[parent] -= 1
                if not children[parent]:
                    del known[parent]
            yield node, low, high
            if children[node]:
                known[node] = (low, high)


def _largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def _sorted_rows(right: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, Block]:
    right = right.take(pa.array(np.argsort(right.column("vec_id").to_numpy(), kind="stable")))
    return right.column("vec_id").to_numpy(), right.column("label").to_numpy(), Block(_matrix(right.column("z"), width))


def best_of_label(anchors, ids, labels, block: Block, own_id, own_label, k: int):
    """(anchor, rows, scores) of the k best rows of the anchor's label in the block, its own id left out."""
    for node, low, high in block.walk(anchors):
        fits = np.flatnonzero((labels == own_label[node]) & (ids != own_id[node]))
        use = fits[high[fits] >= _largest(low[fits], k)]
        score = block.score(anchors[node], use)
        low[use] = high[use] = score
        best = np.argsort(-score, kind="stable")[:k]  # rows come by vec_id, so ties go to the smaller one
        yield node, use[best], score[best]


def in_windows(anchors, ids, labels, block: Block, own_id, own_label, positives, k: int, least: int, most: int):
    """(anchor, position of the positive, rows, scores): the k best rows of another label with
    ``least`` * p <= 100 * score <= ``most`` * p, for each score p of the anchor's positives."""
    for node, low, high in block.walk(anchors):
        fits = np.flatnonzero((labels != own_label[node]) & (ids != own_id[node]))
        needed = np.zeros(len(fits), bool)
        lower, upper = low[fits], high[fits]
        for p in positives[node]:
            a, b = least * p / 100, most * p / 100
            if a > b:
                continue
            sure = (lower >= a) & (upper <= b)
            needed |= (upper >= max(a, _largest(lower[sure], k))) & (lower <= b)
        use = fits[needed]
        score = block.score(anchors[node], use)
        low[use] = high[use] = score
        for j, p in enumerate(positives[node]):
            kept = (100 * score >= least * p) & (100 * score <= most * p)
            mine, s = use[kept], score[kept]
            best = np.argsort(-s, kind="stable")[:k]
            yield node, j, mine[best], s[best]


def _positives(width: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [np.zeros(0, np.int64)] for name in (*_ANCHOR, "positive_id", "score")}
        if len(left) and len(right):
            ids, labels, block = _sorted_rows(right, width)
            key = [left.column(c).to_numpy() for c in _ANCHOR]
            for node, rows, score in best_of_label(_matrix(left.column("z"), width), ids, labels, block, key[0], left.column("label").to_numpy(), k):
                for name, values in zip(out, (np.full(len(rows), key[0][node]), np.full(len(rows), key[1][node]), ids[rows], score)):
                    out[name].append(values)
        return pa.table({name: np.concatenate(parts) for name, parts in out.items()})

    return run


def _negatives(width: int, k: int, least: int, most: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [np.zeros(0, np.int64)] for name in (*_ANCHOR, "place", "negative_id", "score")}
        if len(left) and len(right):
            ids, labels, block = _sorted_rows(right, width)
            key = [left.column(c).to_numpy() for c in _ANCHOR]
            windows = left.column("windows").to_pylist()
            for node, j, rows, score in in_windows(_matrix(left.column("z"), width), ids, labels, block, key[0], left.column("label").to_numpy(), windows, k, least, most):
                for name, values in zip(out, (np.full(len(rows), key[0][node]), np.full(len(rows), key[1][node]), np.full(len(rows), j), ids[rows], score)):
                    out[name].append(values)
        return pa.table({name: np.concatenate(parts) for name, parts in out.items()})

    return run


def _part_of(anchors: DataFrame, n: int, width: int) -> DataFrame:
    """Anchors with their part: cells of about ``ANCHOR_BLOCK`` / 2 anchors by the signs of random projections, larger cells split by hash."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / ANCHOR_BLOCK)))))
    planes = np.random.default_rng(13).normal(size=(width, bits))

    def run(batches):
        for batch in batches:
            side = (_matrix(batch.column("z"), width) @ planes > 0).astype(np.int64)
            cell = side @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(batch), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    celled = stage(anchors.mapInArrow(run, "anchor_id long, print long, label long, z array<int>, cell long"), "anchors")
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"))
    parts = F.greatest(F.ceil(F.col("n") / ANCHOR_BLOCK), F.lit(1))
    return celled.join(sizes, "cell").withColumn(
        "part", F.concat_ws("-", F.col("cell").cast("string"), F.pmod(F.xxhash64(F.lit(1), *_ANCHOR), parts).cast("string"))).drop("cell", "n")


def mine(rows: DataFrame, every: int, n_positives: int, n_negatives: int, least: int, most: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` is the result of :func:`whole_rows` with the labels to use.
    Anchors are the distinct rows whose vec_id ``every`` divides; rows of an
    anchor's own vec_id are neither its positives nor its negatives.  All rows
    are candidates, repeated ones as often as they occur.  ``least`` and
    ``most`` are the window in hundredths of the positive's score; a negative
    positive score leaves no window.  Shorter vectors count as filled with
    zeros.  Anchors without positives, and empty tables, give no rows.
    """
    spark = rows.sparkSession
    rows = stage(rows, "rows")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("z")).alias("width")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select(
        F.col("vec_id").alias("anchor_id"), F.xxhash64("label", "z").alias("print"), "label", "z").distinct()
    n = anchors.count() if facts["n"] else 0
    if not n:
        return spark.createDataFrame([], schema)
    width = max(1, facts["width"])
    blocks = -(-facts["n"] // ROW_BLOCK)
    parted = stage(_part_of(anchors, n, width), "anchor_parts")
    parts = parted.select(F.col("part").alias("to")).distinct()

    # dealt by place in the staged files, so that equal rows spread and every try deals alike
    block = F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(blocks)).cast("int")
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # the stated query set, in parts, against all rows, in blocks
    sent = rows.select("*", block.alias("block")).join(
        parts.withColumn("block", each_block), "block").groupBy("to", "block")
    asked = parted.withColumn("block", each_block)

    found = asked.groupBy("part", "block").cogroup(sent).applyInArrow(
        _positives(width, n_positives), "anchor_id long, print long, positive_id long, score long")
    order = Window.partitionBy(*_ANCHOR).orderBy(F.col("score").desc(), "positive_id")
    positives = stage(found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < n_positives), "positives")
    windows = positives.groupBy(*_ANCHOR).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("windows"))

    asked = parted.join(windows, _ANCHOR).withColumn("block", each_block)
    found = asked.groupBy("part", "block").cogroup(sent).applyInArrow(
        _negatives(width, n_negatives, least, most), "anchor_id long, print long, place long, negative_id long, score long")
    order = Window.partitionBy(*_ANCHOR, "place").orderBy(F.col("score").desc(), "negative_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return best.withColumnRenamed("score", "negative_score").join(
        positives.withColumnRenamed("score", "positive_score"), [*_ANCHOR, "place"]).select(*(c.split()[0] for c in schema.split(", ")))
