"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from partsmith.session import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; links run from larger to smaller."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node that has a link in ``links`` (u, v: long).

    Links with a null end are left out.  Each round is written to the shared
    folder; rounds end when the links no longer change, that is when every
    node is linked to its root.  Nothing but a count and a checksum of the
    links reaches the driver.
    """
    links = links.filter("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stage(links, "links")
    state = None
    while True:
        sums = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(sums) == state:
            break
        state = tuple(sums)
        links = stage(_small_star(_large_star(links)), "links")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
