"""Near-duplicates: banded MinHash candidates, pruned by sequential Bayesian tests, verified on the full shingle sets.

1. One scan writes, per row, the size and a 128-bit fingerprint of its shingle
   set and its band keys.  Equal sets are one node.
2. Nodes that share a band key are candidates; only they get a long signature.
   A first round compares each with the smallest node of its bucket only.
3. Signatures are compared batch by batch; a pair goes as soon as the posterior
   probability of reaching the threshold is below ``MISS``.  Survivors are
   verified on their full sets.
4. A second round compares all nodes of a bucket that are not yet in one
   component, in blocks, so no candidate pair is left out, and large buckets of
   mutual copies cost no more than their size.

Row counts per bucket, component and centre are aggregated before the shuffle,
and large centres are salted; nothing is capped.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from partsmith.llm.components import components
from partsmith.llm.words import Words, shingles, slices
from partsmith.session import stage

BANDS, ROWS = 40, 6
#: hashes of a signature, one byte each; the first BANDS * ROWS make the bands
HASHES = 1024
BATCH = 128
#: probability at which a pair is given up before its exact test
MISS = 1e-5
BLOCK = 500
PER_CENTER = 200

_RNG = np.random.default_rng(77)
_XOR = _RNG.integers(0, 2**32, (HASHES, 1), dtype=np.uint32)
_ODD = _RNG.integers(0, 2**32, (HASHES, 1), dtype=np.uint32) | np.uint32(1)
_PLACES = np.uint64(1) << np.arange(0, 8 * ROWS, 8, dtype=np.uint64)

NODE_SCHEMA = "row long, doc_id long, text_key long, n_shingles long, print binary, bands array<long>"


def _min_hashes(distinct: np.ndarray, n: int) -> np.ndarray:
    low = (distinct >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(out, ((low[at:at + 1024] ^ _XOR[:n]) * _ODD[:n]).min(axis=1), out=out)
    return out


def _signature(distinct: np.ndarray, n: int = HASHES) -> np.ndarray:
    """One well-mixed byte of each of the first ``n`` minima; minima themselves are small numbers, alike in all texts of a length."""
    mins = _min_hashes(distinct, n)
    mins = (mins ^ (mins >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((mins ^ (mins >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(24)).astype(np.uint8)


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """The bytes of a band and its number, so that equal keys are equal bands."""
    parts = sig[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) @ _PLACES
    return (parts | np.arange(BANDS, dtype=np.uint64) << np.uint64(8 * ROWS)).view(np.int64)


def _describe(width: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                w = Words(batch.column("text"))
                sizes, prints, bands = [], [], []
                for a, b in zip(w.row_at[:-1], w.row_at[1:]):
                    distinct = np.unique(shingles(w.hash[a:b], width))
                    sizes.append(len(distinct))
                    if not len(distinct):
                        prints.append(None), bands.append(None)
                        continue
                    prints.append(xxhash.xxh3_128_digest(distinct.tobytes()))
                    bands.append(_band_keys(_signature(distinct, BANDS * ROWS)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()),
                     pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "text_key", "n_shingles", "print", "bands"])

    return run


def _sign(width: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                w = Words(batch.column("text"))
                distinct = [np.unique(shingles(w.hash[a:b], width)) for a, b in zip(w.row_at[:-1], w.row_at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array([_signature(d).tobytes() for d in distinct], pa.binary()),
                     pa.array([len(d) for d in distinct], pa.int64())], names=["node", "sig", "n_shingles"])

    return run


@lru_cache(maxsize=8)
def least_matches(percent: int) -> tuple[int, ...]:
    """Fewest equal hashes among the first BATCH, 2 * BATCH, ... at which a pair is kept.

    With a uniform prior, P(similarity >= t | m of n equal) = P(Bin(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < MISS:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _survive(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of signatures stay after all batches."""
    alive, equal = np.arange(len(left)), np.zeros(len(left), np.int32)
    for k, least in enumerate(least_matches(percent)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (left[alive, part] == right[alive, part]).sum(axis=1)
        keep = equal >= least
        alive, equal = alive[keep], equal[keep]
        if not len(alive):
            break
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _prune(percent: int):
    def run(batches):
        for batch in batches:
            if len(batch):
                alive = _survive(_signatures(batch.column("sig_u")), _signatures(batch.column("sig_v")), percent)
                yield batch.select(["u", "v"]).take(pa.array(alive))

    return run


def _compare_blocks(percent: int):
    """Pairs (u > v) of different roots: the visitors of a block (rows outside the bucket's main component) against its residents.

    Rows come sorted by key and blocks, at most a block of each kind.  A pair
    is compared in the first of the bands that it shares.
    """

    def pairs(key, rows):
        node, root, side, other_root, size, sig = (np.concatenate(x) for x in zip(*rows))
        band = key[0] >> (8 * ROWS)
        blocks = sig[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS)
        a, b = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        out = []
        for i in a:  # one row against the block at a time
            sizes = size[b]
            can = (root[b] != root[i]) & (~other_root[b] | (node[b] < node[i]))
            other = b[can & (100 * np.minimum(sizes, size[i]) >= percent * np.maximum(sizes, size[i]))]
            if len(other) and band:
                other = other[~(blocks[other, :band] == blocks[i, :band]).all(axis=2).any(axis=1)]
            if len(other):
                hit = other[_survive(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other], percent)]
                out.append(np.stack([np.maximum(node[i], node[hit]), np.minimum(node[i], node[hit])]))
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)

    def run(batches):
        held, held_key = [], None
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            node, root, side, size = (batch.column(c).to_numpy() for c in ("node", "root", "side", "n_shingles"))
            outside = batch.column("other").to_numpy(zero_copy_only=False)
            sig = _signatures(batch.column("sig"))
            found = []
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                here = tuple(key[:, a])
                if held and here != held_key:
                    found.append(pairs(held_key, held))
                    held = []
                held_key = here
                held.append((node[a:b], root[a:b], side[a:b], outside[a:b], size[a:b], sig[a:b]))
            if found:
                uv = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(uv[0]), pa.array(uv[1])], names=["u", "v"])
        if held:
            uv = pairs(held_key, held)
            yield pa.RecordBatch.from_arrays([pa.array(uv[0]), pa.array(uv[1])], names=["u", "v"])

    return run


def _verify(width: int, percent: int):
    """Exact test of each member against its centre; rows come sorted, the centre's text before its members."""

    def run(batches):
        center, at = None, None
        for whole in batches:
            for batch in slices(whole):
                w = Words(batch.column("text"))
                u, v = [], []
                ids = zip(*(batch.column(c).to_pylist() for c in ("center", "salt", "member")))
                for (c, s, m), a, b in zip(ids, w.row_at[:-1], w.row_at[1:]):
                    distinct = np.unique(shingles(w.hash[a:b], width))
                    if m == -1:
                        center, at = distinct, (c, s)
                    elif at == (c, s):
                        both = len(np.intersect1d(center, distinct, assume_unique=True))
                        if 100 * both >= percent * (len(center) + len(distinct) - both):
                            u.append(m), v.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full sets reach the threshold; ``texts`` has node and text."""
    pairs = stage(pairs, "minhash-pairs")
    sizes = pairs.groupBy("v").agg(F.ceil(F.count("*") / PER_CENTER).alias("parts"))
    salted = stage(pairs.join(sizes, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).alias("salt")), "minhash-salted")
    members = salted.join(texts.withColumnRenamed("node", "u"), "u").select(
        F.col("v").alias("center"), "salt", F.col("u").alias("member"), "text")
    centers = salted.select(F.col("v").alias("node"), "salt").distinct().join(texts, "node").select(
        F.col("node").alias("center"), "salt", F.lit(-1).cast("long").alias("member"), "text")
    rows = members.unionAll(centers).repartition("center", "salt").sortWithinPartitions("center", "salt", "member")
    return rows.mapInArrow(_verify(width, percent), "u long, v long")


def near_duplicates(docs: DataFrame, width: int, percent: int = 80) -> DataFrame:
    """Every row of ``docs`` with its near-duplicate class: doc_id, text_key, n_shingles, component_id, kept, copy.

    A row's set holds its distinct shingles of ``width`` lower-cased words (the
    whole sequence as one, if there are fewer words).  Rows are linked when
    100 * intersection >= percent * union; component_id is the smallest doc_id
    that can be reached, kept says that it is the row's own.  A null, empty or
    blank text has n_shingles 0 and no links.  Rows without doc_id are linked
    like others but never give a class its id; alone, theirs is null and they
    are kept.  Rows of equal doc_id are rows of their own.  copy is false for
    exactly one row of each class and for every row without links.  text_key
    is a hash of the text.  Other columns are left out.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = read.withColumn("text_key", F.xxhash64("text"))
    nodes = stage(read.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_describe(width), NODE_SCHEMA), "minhash")

    sets = nodes.filter("print is not null")
    first = sets.groupBy("print").agg(F.min("row").alias("node"))
    of_row = stage(sets.select("row", "doc_id", "text_key", "print").join(first, "print").drop("print"), "minhash-nodes")
    copies = of_row.filter("row <> node").select("row")
    distinct = sets.join(copies, "row", "left_anti")

    # candidates: nodes with a band key in common
    bands = distinct.select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).filter("n > 1")
    shared = stage(bands.join(buckets, "key"), "minhash-buckets")  # key, node, center, n
    wanted = shared.select("node").distinct()
    keys = of_row.filter("row = node").join(wanted, "node").select("node", "doc_id", "text_key")
    same_text = F.col("k.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("k.text_key") == F.col("d.text_key"))
    texts = stage(read.alias("d").join(keys.alias("k"), same_text).select("k.node", "d.text").dropDuplicates(["node"]), "minhash-texts")
    sigs = stage(texts.mapInArrow(_sign(width), "node long, sig binary, n_shingles long"), "minhash-signatures")

    # first round: each node with the smallest of its buckets
    stars = shared.filter("node <> center").select(F.col("node").alias("u"), F.col("center").alias("v")).distinct()
    with_sigs = stars.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("sig_u")), "u").join(
        sigs.select(F.col("node").alias("v"), F.col("sig").alias("sig_v")), "v")
    links = stage(_confirmed(with_sigs.mapInArrow(_prune(percent), "u long, v long"), texts, width, percent), "minhash-stars")

    # second round: whatever shares a bucket and is not in one component yet.  The main component of a bucket, that of
    # its smallest node, needs no comparison with itself: its nodes stay in one block each, only the others visit all blocks
    roots = components(links)
    placed = shared.join(roots, "node", "left").select("key", "node", "center", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.when(F.col("node") == F.col("center"), F.col("root"))).alias("main"))
    apart = placed.join(mixed.filter("low <> high").select("key", "main"), "key").select(
        "key", "node", "root", (F.col("root") != F.col("main")).alias("other"))
    apart = stage(apart, "minhash-mixed")
    sizes = apart.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.count_if("other") / BLOCK).alias("visits"))
    dealt = apart.join(sizes, "key")

    def all_of(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    columns = ["key", "node", "root", "other"]
    residents = dealt.select(*columns, F.pmod(F.xxhash64("node"), "blocks").alias("i"), all_of("visits").alias("j"), F.lit(0).alias("side"))
    visitors = dealt.filter("other").select(*columns, F.pmod(F.xxhash64("node"), "visits").alias("j"), all_of("blocks").alias("i"), F.lit(1).alias("side"))
    spread = residents.unionByName(visitors)
    compared = spread.join(sigs, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        _compare_blocks(percent), "u long, v long")
    more = stage(_confirmed(compared, texts, width, percent), "minhash-links")
    roots = components(links.unionAll(more))

    placed = of_row.join(roots, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("root"))
    heads = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"),
                                       F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"))
    classes = placed.join(heads, "root").select("row", "component_id", (F.col("row") != F.col("head.row")).alias("copy"))
    # rows without a set stand alone
    out = nodes.select("row", "doc_id", "text_key", "n_shingles").join(classes, "row", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("copy", F.lit(False)).alias("copy"))


def deduplicate(docs: DataFrame, width: int, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, that of the smallest doc_id; all columns as given.

    Rows of equal doc_id and equal text count as one document, also if empty.
    """
    copies = near_duplicates(docs, width, percent).groupBy("doc_id", "text_key").agg(F.min("copy").alias("copy")).filter("copy")
    copies = copies.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    keyed = docs.withColumn("_text_key", F.xxhash64(F.col("text").cast("string")))
    left = keyed.join(copies, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_anti")
    return left.dropDuplicates(["doc_id", "_text_key"]).select(*docs.columns)
