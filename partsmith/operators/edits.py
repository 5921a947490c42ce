"""Edit tables: of several edits of one key the last one holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ORDER = "seq"


def last_edits(edits: DataFrame, keys: list[str], order: str = ORDER) -> DataFrame:
    """One edit per key: the one of highest ``order``, if there is such a column, else the greatest by value.

    A map-side aggregate, so a key with many edits stays cheap.  Edits with a
    null key are left out; ``order`` is dropped.
    """
    rest = [c for c in edits.columns if c not in keys and c != order]
    fields = ([order] if order in edits.columns else []) + rest
    known = edits.where(" and ".join(f"`{k}` is not null" for k in keys))
    if not fields:
        return known.select(*keys).distinct()
    last = known.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
