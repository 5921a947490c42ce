"""Input tables, derived views and shared intermediate results of one data folder."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from partsmith.catalog.views import TABLES, VIEWS
from partsmith.session import stage, tune

_open: dict[tuple[str, str], "Tables"] = {}

#: views with a row per row of a given table: a given file is one task however many rows it packs, so these are dealt out anew
SPREAD = ("raw_rows", "review_tasks", "review_events", "callbacks")


class Tables:
    """Views are written once to the shared folder and read back, as a nightly job would."""

    def __init__(self, spark: SparkSession, sf_dir: str, instead: dict[str, str] | None = None):
        """``instead`` reads one view under another's name (the benchmark's larger rows)."""
        self.spark, self.sf_dir, self.instead = tune(spark), sf_dir, instead or {}
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                deps, sql = VIEWS[self.instead.get(name, name)]
                df = self.spark.sql(sql, **{d: self[d] for d in deps})
                if name in self.instead or name in SPREAD:
                    # Real imports come as many files; one small file would be one task.
                    df = df.repartition(2 * self.spark.sparkContext.defaultParallelism)
                df = stage(df, name)
            self._made[name] = df
        return self._made[name]

    def keep(self, name: str, build) -> DataFrame:
        """A derived result that several queries read, staged on first use."""
        if name not in self._made:
            self._made[name] = stage(build(), name)
        return self._made[name]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Tables(spark, sf_dir)
    return _open[key]


def forget() -> None:
    """Drop every shared result (between benchmark runs)."""
    _open.clear()
