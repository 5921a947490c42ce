"""Registration of a query together with its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from partsmith.catalog.oracle import with_ctes
from partsmith.catalog.tables import Tables, tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with the SQL it must agree with."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register
