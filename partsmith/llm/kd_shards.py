"""K-d tree shards: documents are split again and again at the byte-weighted median along the widest dimension of their metadata.

Only DataFrame operations run on the rows.  One scan of the texts writes a
narrow table (size, checksum, one 62-bit key per dimension); every split is
then found from aggregates of that table.  A key is the coordinate (31 bits)
followed by a tie-breaking hash (31 bits), so a value that a third of all rows
share can still be cut anywhere.  The weighted median of a node is found by
descending the key 16 bits at a time: one aggregation by (node, next 16 bits)
serves all nodes of a level, and only one row per node reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.session import stage

OVERHEAD_BYTES = 16
COORD_BITS = TIE_BITS = 31
STEPS = (16, 16, 15, 15)
DIMENSIONS = ("doc_id", "source", "lang")


@dataclass
class Node:
    """``shards`` consecutive shards beginning at ``first``; a split node has a dimension, a cut and two children."""

    first: int
    shards: int
    dim: int = -1
    cut: int = -1
    left: Node | None = None
    right: Node | None = None

    def leaves(self) -> list[Node]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def place(self) -> Column:
        """First shard of the leaf that a row belongs to."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(f"_k{self.dim}") <= F.lit(self.cut), self.left.place()).otherwise(self.right.place())


def _coordinate(col: str, kind: str, low, high) -> Column:
    top = (1 << COORD_BITS) - 1
    if kind == "string":
        spot = F.xxhash64(F.col(col)).bitwiseAND(F.lit(top))
    else:
        width = float(high) - float(low) if high is not None and float(high) > float(low) else 1.0
        spot = F.floor((F.col(col).cast("double") - F.lit(float(low or 0))) / F.lit(width) * F.lit(float(top))).cast("bigint")
    return F.coalesce(spot, F.lit(0).cast("bigint"))


def metadata(docs: DataFrame, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """The narrow table: doc_id, size, text_crc32, the row's number and one key per dimension.

    A null text has no bytes; a null dimension has coordinate 0.
    """
    kinds = dict(docs.dtypes)
    dims = tuple(d for d in dims if d in kinds)
    numbers = [d for d in dims if kinds[d] != "string"]
    ends = docs.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in numbers for f in (F.min, F.max)]).first() if numbers else {}
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.monotonically_increasing_id()
    tie = F.xxhash64(F.col("doc_id"), F.crc32(F.encode(text, "UTF-8")), row).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    out = docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD_BYTES).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), row.alias("_row"), tie.alias("_tie"),
        *[_coordinate(d, kinds[d], *((ends[f"min_{d}"], ends[f"max_{d}"]) if d in numbers else (0, 0))).alias(f"_c{i}")
          for i, d in enumerate(dims)])
    return out.select("doc_id", "size", "text_crc32", "_row",
                      *[(F.shiftleft(F.col(f"_c{i}"), TIE_BITS) + F.col("_tie")).alias(f"_k{i}") for i in range(len(dims))])


def _split_level(meta: DataFrame, root: Node, n_dims: int, total_shards: int) -> None:
    """Cut every leaf that still holds more than one shard."""
    open_nodes = {n.first: n for n in root.leaves() if n.shards > 1}
    rows = meta.withColumn("_node", root.place()).filter(F.col("_node").isin(list(open_nodes)))
    spans = {r["_node"]: r for r in rows.groupBy("_node").agg(
        F.sum("size").alias("total"),
        *[(F.max(F.shiftright(f"_k{i}", TIE_BITS)) - F.min(F.shiftright(f"_k{i}", TIE_BITS))).alias(f"w{i}")
          for i in range(n_dims)]).collect()}  # at most one row per shard
    state = {}
    for first, node in open_nodes.items():
        span = spans.get(first)
        node.dim = max(range(n_dims), key=lambda i: (span[f"w{i}"], -i)) if span else 0
        goal = span["total"] * (node.shards // 2) / node.shards if span else 0
        state[first] = {"prefix": 0, "below": 0, "goal": goal}
    def choose(value_of, cast: str) -> Column:
        out = None
        for first in spans:
            value = F.lit(value_of(first)).cast(cast)
            out = F.when(F.col("_node") == first, value) if out is None else out.when(F.col("_node") == first, value)
        return out

    left_bits = sum(STEPS)
    if spans:
        key = None
        for first in spans:
            k = F.col(f"_k{open_nodes[first].dim}")
            key = F.when(F.col("_node") == first, k) if key is None else key.when(F.col("_node") == first, k)
        rows = rows.select("_node", "size", key.alias("_key"))
    for bits in STEPS if spans else ():
        high, left_bits = left_bits, left_bits - bits
        inside = rows.filter(F.shiftright("_key", high) == choose(lambda f: state[f]["prefix"], "bigint"))
        sums = inside.groupBy("_node", F.shiftright("_key", left_bits).alias("_next")).agg(F.sum("size").alias("bytes"))
        w = Window.partitionBy("_node").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        upto = sums.withColumn("upto", F.sum("bytes").over(w) + choose(lambda f: state[f]["below"], "bigint"))
        last = F.max("_next").over(Window.partitionBy("_node"))
        goal = choose(lambda f: state[f]["goal"], "double")
        hit = upto.withColumn("_last", last).filter((F.col("upto") >= goal) | (F.col("_next") == F.col("_last")))
        for r in hit.groupBy("_node").agg(F.min(F.struct("_next", "upto", "bytes")).alias("x")).collect():
            x = r["x"]
            state[r["_node"]] |= {"prefix": x["_next"], "below": x["upto"] - x["bytes"], "upto": x["upto"]}
    for first, node in open_nodes.items():
        s, half = state[first], node.shards // 2
        # the document on the cut goes to the side that it leaves nearer to its goal
        with_it = "upto" in s and s["upto"] - s["goal"] <= s["goal"] - s["below"]
        node.cut = s["prefix"] if with_it else s["prefix"] - 1
        node.left, node.right = Node(first, half), Node(first + half, node.shards - half)


def build_tree(meta: DataFrame, n_shards: int) -> Node:
    n_dims = sum(c.startswith("_k") for c in meta.columns)
    root = Node(0, n_shards)
    while any(n.shards > 1 for n in root.leaves()):
        _split_level(meta, root, n_dims, n_shards)
    return root


def shard(docs: DataFrame, n_shards: int = 40, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Every row of ``docs`` with its shard and its place in it.

    Sizes count UTF-8 bytes plus 16; shards differ by a few documents at most
    because each cut falls within one document of the weighted median.  Null
    and empty texts, null dimensions and repeated rows each take a place of
    their own.  An empty table gives no rows.  Other columns are left out.
    """
    meta = stage(metadata(docs, dims), "kd-meta")
    placed = meta.withColumn("shard", build_tree(meta, n_shards).place().cast("int"))
    # places: counted per shard and input split, so that no task holds a whole shard
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_row"))
    return placed.withColumn("_within", within).join(offsets, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_before") + F.col("_within") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
