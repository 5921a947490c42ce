"""Reading headed tables from CSV or Parquet, and writing reports."""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from partsmith.operators import ingest
from partsmith.session import stage
from partsmith.sources import csv_ranges


@dataclass
class Imported:
    header: DataFrame  # title_id, pos, name
    rows: DataFrame    # title_id, row_id, row_index, col1..colN
    counts: DataFrame  # title_id, total_rows


#: places within a file; the number of a file stands above them, so that row ids differ across files
PLACES = 1 << 40


def row_id_of(title_id: int, place: Column) -> Column:
    return F.lit(title_id * PLACES) + place.cast("long")


def import_frame(df: DataFrame, title_id: int, place: str, max_cols: int | None = None,
                 names: list[str | None] | None = None) -> Imported:
    """A table whose columns are the header (or ``names``); ``place`` is a column that orders its rows.

    ``place`` must be a unique number from 0 on: it is carried, not recounted,
    so the import needs no global sort.  The row index counts from 2 (the
    header is row 1); the row id is unique across files.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c != place]
    names = ingest.header_names(columns if names is None else names, max_cols)
    header = spark.createDataFrame(
        [(title_id, i, n) for i, n in enumerate(names, 1)], "title_id bigint, pos int, name string")
    plain = df.toDF(*[c if c == place else f"_{i}" for i, c in enumerate(df.columns)])  # header names may repeat
    cells = ingest.import_cells(plain, [place], max_cols)
    rows = cells.select(
        F.lit(title_id).cast("long").alias("title_id"), row_id_of(title_id, F.col(place)).alias("row_id"),
        (F.col(place) + 2).cast("long").alias("row_index"), *[f"col{i}" for i in range(1, len(names) + 1)])
    return Imported(header, rows, rows.groupBy("title_id").agg(F.count("*").alias("total_rows")))


def read_csv(spark: SparkSession, path: str, title_id: int, max_cols: int | None = None, sep: str = ",") -> Imported:
    """A sheet of one CSV file, or of several in the order of their names; the first record of each is the header.

    Records may hold quoted line breaks.  Files are read in byte ranges side by
    side (:mod:`partsmith.sources.csv_ranges`), and the row index is that of
    the whole sheet.
    """
    found = csv_ranges.records(spark, path, sep)
    files = stage(found.groupBy("file").agg(F.count("*").alias("n")), "csv_files")
    top = found.where("record = 0").orderBy("file").limit(1).collect()
    if not top:
        raise ValueError(f"{path} has no header")
    names = next(csv.reader(io.StringIO(top[0]["text"].lstrip("\ufeff"), newline=""), delimiter=sep))
    # a row per file: what stands before it in the sheet
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum(F.col("n") - 1).over(ahead), F.lit(0)).alias("base"))
    cells = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), {"sep": sep, "escape": '"'})
    body = found.where("record > 0").join(base, "file").select(
        (F.col("base") + F.col("record") - 1).alias("_place"), cells.alias("cells")).select("cells.*", "_place")
    return import_frame(body, title_id, "_place", max_cols, [n or None for n in names])


def read_parquet(spark: SparkSession, path: str, title_id: int, place: str, max_cols: int | None = None) -> Imported:
    return import_frame(spark.read.parquet(path), title_id, place, max_cols)


def together(files: list[Imported]) -> Imported:
    """Several files as one import; a file with fewer columns has null cells."""
    return Imported(*[reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [getattr(f, part) for f in files])
                      for part in ("header", "rows", "counts")])


def replace_partitions(df: DataFrame, path: str, key: str = "title_id") -> None:
    """Overwrite only the partitions present in ``df``: a re-run replaces its own files."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
