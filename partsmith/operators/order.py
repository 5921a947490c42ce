"""Places in a global order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from partsmith.session import stage

#: rows from the top, or of the last range, that Spark's top-k may merge for a page
NEAR = 10_000
CUTS = 32
SAMPLE = 2048


def numbered(rows: DataFrame, order: list[Column | str], place: str = "place") -> DataFrame:
    """``rows`` with their place (from 0) in ``order``, which should settle ties.

    Rows are sorted in ranges, so a value that many rows share is cut too if a
    later column of the order differs; a row per range numbers them through.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(sorted_.withColumn("_range", F.spark_partition_id()).withColumn("_at", within), "ordered")
    sizes = placed.groupBy("_range").agg((F.max("_at") + 1).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    return placed.join(first, "_range").select(*rows.columns, (F.col("_first") + F.col("_at")).alias(place))


def _behind(columns: list[tuple[str, bool]], cut: Row) -> Column:
    """True where a row stands behind ``cut``; nulls are the smallest values, as in the sort."""
    out = F.lit(False)
    for (name, down), value in reversed(list(zip(columns, cut))):
        key, bound = F.col(name), F.lit(value)
        if value is None:
            further = F.lit(False) if down else key.isNotNull()
        else:
            further = F.coalesce(key < bound, F.lit(True)) if down else F.coalesce(key > bound, F.lit(False))
        out = further | (key.eqNullSafe(bound) & out)
    return out


def page_of(rows: DataFrame, columns: list[tuple[str, bool]], offset: int, size: int, near: int | None = None) -> DataFrame:
    """``size`` rows from the ``offset``-th on, in the order of ``columns``: pairs of a name and whether it descends.

    Nulls come last where a column descends, else first.  A page near the top
    is Spark's own top-k.  For a deeper one the places are found first: the sort
    columns are counted in ranges, with cuts taken from a bounded sample of
    rows; the ranges the page touches are cut again until they hold few rows,
    and only these rows are sorted.  Cuts hold all columns, so a value that many
    rows share is cut by the later ones.  The sample decides how fast ranges
    shrink, not what comes out.  Rows equal in all columns are one place: their
    range is not cut further, and which of them a page shows is open.  ``near``
    rows are few enough for one top-k.
    """
    near = NEAR if near is None else near
    order = [F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first() for name, down in columns]
    if offset + size <= near:
        return rows.orderBy(*order).offset(offset).limit(size)
    keys = stage(rows.select(*[name for name, _ in columns]), "page_keys")
    skipped, within, left = 0, F.lit(True), None
    while left is None or left > near + size:
        sample = keys.where(within).orderBy(F.rand(1)).limit(SAMPLE).orderBy(*order).collect()
        cuts = list(dict.fromkeys(sample[len(sample) // CUTS::max(1, len(sample) // CUTS)]))
        part = sum((_behind(columns, cut).cast("int") for cut in cuts), F.lit(0))
        sizes = dict(keys.where(within).groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
        before, touched = skipped, []
        for at in sorted(sizes):
            if before < offset + size and before + sizes[at] > offset:
                if not touched:
                    skipped = before
                touched.append(at)
            before += sizes[at]
        if not touched:
            return rows.limit(0)
        now = sum(sizes[at] for at in touched)
        if touched[0] > 0:
            within = within & _behind(columns, cuts[touched[0] - 1])
        if touched[-1] < len(cuts):
            within = within & ~_behind(columns, cuts[touched[-1]])
        if now == left:
            break
        left = now
    return rows.where(within).orderBy(*order).offset(offset - skipped).limit(size)
