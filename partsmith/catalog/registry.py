"""All registered queries.  Each catalog module fills its share of the registry."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F

from partsmith.catalog.base import ORACLES, QUERIES
from partsmith.catalog.tables import tables

MODULES = ("matching", "libraries", "cleaned", "scalars", "searches", "reports", "sources", "taxonomies", "mappings",
           "reviews", "retrievals", "models", "externals", "exports", "streams")

for _m in MODULES:
    import_module(f"partsmith.catalog.{_m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from partsmith.catalog.cleaned import clean_run

    return clean_run(tables(spark, sf_dir)).cleaned.groupBy("title_id", "status").agg(
        F.count("*").alias("n_rows"), F.avg("quality_score").alias("avg_quality"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
