"""A key for documents that may have no id."""

from pyspark.sql import Column, functions as F


def doc_key() -> Column:
    """doc_id, or for a row without one a number above any real id that its text decides."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62) + F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(2**61)))
