"""Centroid clustering over a vector-approximation file.

Every vector is written twice: in full, and as a row of few-bit cells, one per
dimension, whose edges are quantiles of a bounded sample.  To assign vectors, a
task reads cells only: two tables per centroid and dimension (least and most
squared distance from any number of the cell to the centroid) are looked up and
added to an interval of distances per centroid.  Where one interval lies below
all others the vector is settled; where intervals overlap its full row is
fetched, by a join on the vector's id, and measured against the centroids left.
Centroids move by sums over the vectors that changed cluster, so a later round
fetches those and the overlapping ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from partsmith.session import stage

#: bits of a cell, and rows of the sample (first by hash) that gives the edges of the cells
BITS = 4
SAMPLE = 4096
#: numbers beyond this are cut to it, so that squared distances and their sums stay in 64 bits
_MOST = 2**26
KEY = ["vec_id", "print"]
_KEY = "vec_id long, print long"
_RUN = 1000  # copies of a row are listed in runs of so many


def whole_numbers(rows: DataFrame, id_col: str, column: str, width: int, factor: int) -> DataFrame:
    """vec_id, print, z and copies: floor(factor * x) of the vectors with exactly ``width`` finite components.

    ``print`` is a hash of z, which keeps rows of one vec_id apart; rows equal
    in vec_id and z are one row with their number as ``copies``.  Numbers
    beyond 2**26 are cut to it.
    """
    def finite(x: Column) -> Column:
        return F.coalesce((F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x.cast("double")), F.lit(False))

    kept = rows.filter(F.col(id_col).isNotNull() & (F.size(column) == width) & F.forall(column, finite))
    z = F.transform(column, lambda x: F.floor(F.greatest(F.least(x.cast("double") * factor, F.lit(float(_MOST))), F.lit(float(-_MOST)))).cast("int"))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), z.alias("z")).groupBy("vec_id", "z").agg(F.count("*").alias("copies")).select(
        "vec_id", F.xxhash64("z").alias("print"), "z", "copies")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


class Cells:
    """Edges of the cells of each dimension, and what they say about distances."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray, bits: int = BITS):
        n = 1 << bits
        at = np.sort(sample, axis=0).astype(np.int64)
        # edge k of a dimension: cell k holds the numbers from edge k to below edge k + 1; equal edges make empty cells.
        # Edges lie halfway between quantiles and equal steps, so that cells are narrow in the middle and bounded at the ends
        share = np.arange(1, n)[:, None]
        inner = (at[(share[:, 0] * len(at)) // n] + least + share * (most + 1 - least) // n) // 2
        self.edges = np.concatenate([least[None], np.clip(inner, least, most + 1), most[None] + 1]).astype(np.int64)
        self.bits = bits

    def code(self, z: np.ndarray) -> np.ndarray:
        out = np.empty(z.shape, np.uint8)
        for d in range(z.shape[1]):
            out[:, d] = np.searchsorted(self.edges[1:-1, d], z[:, d], "right")
        return out

    def pack(self, code: np.ndarray) -> list[bytes]:
        bits = np.unpackbits(code[:, :, None], axis=2)[:, :, 8 - self.bits:]
        packed = np.packbits(bits.reshape(len(code), -1), axis=1)
        return [row.tobytes() for row in packed]

    def unpack(self, column: pa.Array, width: int) -> np.ndarray:
        size = -(-width * self.bits // 8)
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), size)
        bits = np.unpackbits(raw, axis=1)[:, :width * self.bits].reshape(len(column), width, self.bits)
        return np.packbits(np.concatenate([np.zeros((len(column), width, 8 - self.bits), np.uint8), bits], axis=2), axis=2)[:, :, 0]

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most squared distance per centroid, dimension and cell."""
        low, high = self.edges[:-1].T[None], self.edges[1:].T[None] - 1  # dimension x cell
        c = centroids[:, :, None]
        below, above = c - high, low - c
        least = np.maximum(0, np.maximum(below, above)) ** 2
        most = np.maximum(np.abs(c - low), np.abs(c - high)) ** 2
        return least, most


def intervals(code: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most squared distance of each coded vector (row) from each centroid (column)."""
    low = np.zeros((len(code), len(least)), np.int64)
    high = np.zeros_like(low)
    for d in range(code.shape[1]):
        low += least[:, d, :].T[code[:, d]]
        high += most[:, d, :].T[code[:, d]]
    return low, high


def _bound(cells: Cells, centroids: np.ndarray):
    """``near``: the only centroid that can be nearest, or null; ``open``: bits of those that can be."""
    width = centroids.shape[1]
    least, most = cells.tables(centroids)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                low, high = intervals(cells.unpack(part.column("code"), width), least, most)
                open_ = low <= high.min(axis=1, keepdims=True)
                alone = open_.sum(axis=1) == 1
                near = pa.array(open_.argmax(axis=1).astype(np.int32), mask=~alone)
                bits = pa.array([b.tobytes() for b in np.packbits(open_, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*KEY, "before")), near, bits], names=[*KEY, "before", "near", "open"])

    return run


def _measure(centroids: np.ndarray):
    """The nearest of the centroids left, smaller numbers first at equal distance, by the full vector; its distance."""
    k, width = centroids.shape

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                z = _matrix(part.column("z"), width)
                left = np.unpackbits(np.frombuffer(b"".join(part.column("open").to_pylist()), np.uint8).reshape(len(part), -1), axis=1)[:, :k].astype(bool)
                best = np.full(len(part), np.iinfo(np.int64).max)
                near = np.zeros(len(part), np.int32)
                for c in range(k):
                    some = np.flatnonzero(left[:, c])
                    far = ((z[some] - centroids[c]) ** 2).sum(axis=1)
                    better = far < best[some]
                    best[some[better]], near[some[better]] = far[better], c
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*KEY, "before")), pa.array(near)], names=[*KEY, "before", "near"])

    return run


def assign(file: DataFrame, full: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """The key, before and near of every row of the approximation file (key, code, before)."""
    bounded = stage(file.mapInArrow(_bound(cells, centroids), f"{_KEY}, before int, near int, open binary"), "va_bounds")
    fetched = full.select(*KEY, "z").join(bounded.filter("near IS NULL").select(*KEY, "before", "open"), KEY)
    settled = bounded.filter("near IS NOT NULL").select(*KEY, "before", "near")
    return settled.unionByName(fetched.mapInArrow(_measure(centroids), f"{_KEY}, before int, near int"))


def _moved(changed: DataFrame, full: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Change of the counts and componentwise sums of the clusters; at most clusters x dimensions rows reach the driver."""
    steps = changed.join(full, KEY).select("z", "copies", F.explode(F.array(
        F.struct(F.col("before").alias("c"), F.lit(-1).alias("sign")), F.struct(F.col("near").alias("c"), F.lit(1).alias("sign")))).alias("s"))
    steps = steps.filter("s.c >= 0").select("s.c", (F.col("s.sign") * F.col("copies")).alias("w"), "z")

    def run(batches):
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if len(batch):
                c, w = batch.column("c").to_numpy(), batch.column("w").to_numpy()
                np.add.at(sums, c, _matrix(batch.column("z"), width) * w[:, None])
                np.add.at(counts, c, w)
        used = np.flatnonzero((counts != 0) | (sums != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], names=["c", "n", "s"])

    partial = steps.mapInArrow(run, "c int, n long, s array<long>")
    total = partial.select("c", "n", F.posexplode("s").alias("d", "x")).groupBy("c", "d").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    sums, counts = np.zeros((k, width), object), np.zeros(k, object)
    for r in total:
        sums[r["c"], r["d"]], counts[r["c"]] = int(r["x"]), int(r["n"])
    return counts, sums


def _ranges(full: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest number of each dimension over all vectors; one row of a task and dimension is shuffled."""
    def run(batches):
        low, high = np.full(width, _MOST, np.int64), np.full(width, -_MOST, np.int64)
        for batch in batches:
            if len(batch):
                z = _matrix(batch.column("z"), width)
                low, high = np.minimum(low, z.min(axis=0)), np.maximum(high, z.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    found = full.select("z").mapInArrow(run, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sorted(found.collect())
    return np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows])


def initial(rows: DataFrame, k: int, seed: int) -> list:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; equal ids by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    each = F.explode(F.array_repeat(F.lit(0), F.least(F.col("copies"), F.lit(k)).cast("int")))
    return rows.select("vec_id", "z", key.alias("key"), each.alias("each")).orderBy("key", "z").limit(k).collect()


def cluster(rows: DataFrame, width: int, k: int, rounds: int, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every row of :func:`whole_numbers`.

    ``rounds`` times every vector goes to its nearest centroid (ties: the
    smaller number) and every centroid that has vectors moves to the floor of
    their mean; then vectors are assigned once more.  With fewer than k
    vectors all are centroids; an empty table gives no rows.  Equal vectors
    and repeated ids are all kept.
    """
    spark = rows.sparkSession
    full = stage(rows, "vectors")
    start = initial(full, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["z"] for r in start], np.int64)
    k = len(centroids)
    sample = full.orderBy(F.xxhash64(*KEY), *KEY).limit(SAMPLE).select("z").collect()
    cells = Cells(np.array([r["z"] for r in sample], np.int64), *_ranges(full, width))

    def write(batches):
        for batch in batches:
            code = cells.pack(cells.code(_matrix(batch.column("z"), width))) if len(batch) else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(code, pa.binary())], names=[*KEY, "code"])

    file = stage(full.select(*KEY, "z").mapInArrow(write, f"{_KEY}, code binary"), "va_file")
    counts, sums = np.zeros(k, object), np.zeros((k, width), object)
    placed = None
    for _ in range(rounds):
        before = file.withColumn("before", F.lit(-1)) if placed is None else file.join(placed.selectExpr(*KEY, "near before"), KEY)
        placed = stage(assign(before, full, cells, centroids), "va_placed")
        more, moved = _moved(placed.filter("near <> before"), full, k, width)
        counts, sums = counts + more, sums + moved
        centroids = np.array([[int(x) // int(n) for x in s] if n else list(c) for c, s, n in zip(centroids, sums, counts)], np.int64)
    before = file.withColumn("before", F.lit(-1)) if placed is None else file.join(placed.selectExpr(*KEY, "near before"), KEY)
    placed = stage(assign(before, full, cells, centroids), "va_placed")
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def distances(batches):
        for batch in batches:
            near = batch.column("cluster").to_numpy()
            far = ((_matrix(batch.column("z"), width) - centroids[near]) ** 2).sum(axis=1) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("copies"), batch.column("cluster"), pa.array(far)],
                                             names=["vec_id", "copies", "cluster", "distance"])

    found = stage(full.join(placed.selectExpr(*KEY, "near cluster"), KEY).select("vec_id", "copies", "cluster", "z").mapInArrow(
        distances, "vec_id long, copies long, cluster int, distance long"), "va_distances")
    per = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum((F.col("distance") * F.col("copies")).cast("decimal(38,0)")).alias("s")).collect()}
    most = 2**63 - 1
    facts = spark.createDataFrame([(c, min(int(per[c]), most), min(int(sum(per.values())), most), prints[c]) for c in sorted(per)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    runs = found.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / _RUN).cast("int"))))
    each = F.explode(F.array_repeat(F.lit(0), F.least(F.lit(_RUN), F.col("copies") - _RUN * F.col("run")).cast("int")))
    return runs.withColumn("copy", each).join(F.broadcast(facts), "cluster").select(*(c.split()[0] for c in schema.split(", ")))
