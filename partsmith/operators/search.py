"""Predicates over cleaned rows, results and tasks; sorting and paging."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.functions import text as T
from partsmith.functions.scores import EXPORTABLE
from partsmith.operators.ingest import cells_of
from partsmith.operators.order import page_of

# Sort names a caller may use, and paging defaults.
SORT_FIELDS = {
    "materialCode": "material_code", "materialName": "material_name", "categoryCode": "category_code",
    "createdAt": "created_at", "reviewedAt": "reviewed_at", "exportedAt": "exported_at",
}
DEFAULT_SORT = "created_at"
DEFAULT_PAGE_SIZE = 20


@dataclass(frozen=True)
class CleanedSearch:
    """Only the fields that are set take part; a False flag does not filter."""

    category_codes: tuple[str, ...] = ()
    category_level: int | None = None
    path_prefix: str | None = None
    material_code: str | None = None
    material_name: str | None = None
    specification: str | None = None
    technical_standard: str | None = None
    statuses: tuple[str, ...] = ()
    created: tuple = (None, None)
    reviewed_at: tuple = (None, None)
    exported: tuple = (None, None)
    exportable: bool = False
    reviewed: bool = False
    title_id: int | None = None


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def between(col: str, bounds: tuple) -> list[Column]:
    lo, hi = bounds
    return ([F.col(col) >= F.lit(lo)] if lo is not None else []) + ([F.col(col) <= F.lit(hi)] if hi is not None else [])


def cleaned_predicate(c: CleanedSearch) -> Column:
    out: list[Column] = []
    if c.category_codes:
        out.append(F.col("category_code").isin(*c.category_codes))
    if c.category_level is not None:
        out.append(F.col("category_level") == c.category_level)
    if c.path_prefix:
        out.append(F.startswith("category_code", F.lit(c.path_prefix)) | F.startswith("category_full_path", F.lit(c.path_prefix)))
    for name in ("material_code", "material_name", "specification", "technical_standard"):
        part = getattr(c, name)
        if part:
            out.append(F.contains(F.col(name), F.lit(part)))
    if c.statuses:
        out.append(F.col("status").isin(*c.statuses))
    out += between("created_at", c.created) + between("reviewed_at", c.reviewed_at) + between("exported_at", c.exported)
    if c.exportable:
        out.append(F.col("status").isin(*EXPORTABLE))
    if c.reviewed:
        out.append(F.col("reviewed_at").isNotNull())
    if c.title_id is not None:
        out.append(F.col("title_id") == c.title_id)
    return all_of(out)


def search_cleaned(cleaned: DataFrame, cond: CleanedSearch) -> DataFrame:
    return cleaned.where(cleaned_predicate(cond))


def count_cleaned(cleaned: DataFrame, cond: CleanedSearch) -> DataFrame:
    return search_cleaned(cleaned, cond).agg(F.count("*").alias("n"))


def with_category_name(cleaned: DataFrame, taxonomy: DataFrame) -> DataFrame:
    names = taxonomy.select(F.col("id").alias("category_id"), F.col("category_name"))
    return cleaned.drop("category_name").join(names, "category_id", "left")


def search_results(results: DataFrame, raw: DataFrame, std_id: int | None = None, title_id: int | None = None,
                   statuses: tuple[str, ...] = (), code_part: str | None = None, name_part: str | None = None) -> DataFrame:
    """Filled rows by header, file, status and a text in the first three columns."""
    out = results
    if std_id is not None:
        out = out.where(F.col("std_id") == std_id)
    if title_id is not None:
        out = out.join(raw.where(F.col("title_id") == title_id).select("row_id"), "row_id", "left_semi")
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    for part in (code_part, name_part):
        if part:
            hit = [F.coalesce(F.contains(F.col(c), F.lit(part)), F.lit(False)) for c in ("col1", "col2", "col3")]
            out = out.where(hit[0] | hit[1] | hit[2])
    return out


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """Text means substring, number means equality, list means membership."""
    conditions = []
    for name, value in filters.items():
        col = F.col(name)
        if isinstance(value, str):
            conditions.append(F.contains(col, F.lit(value)))
        elif isinstance(value, (list, tuple, set)):
            conditions.append(col.isin(*value))
        else:
            conditions.append(col == value)
    return df.where(all_of(conditions))


def any_keyword(cleaned: DataFrame, queries: DataFrame, limit: int, max_tokens: int | None = None) -> DataFrame:
    """The ``limit`` newest rows that hold any of a query's tokens: ``(query_id, row_id, place)``.

    ``queries(query_id, words)``; ``max_tokens`` takes the first words only, if
    asked for.  Rows and tokens meet through the token's rarest bigram among
    the rows; only row ids travel with the bigrams, the text is fetched for the
    test.  A row beyond the newest ``limit`` of a token cannot be among the
    newest ``limit`` of a query holding that token.
    """
    words = F.col("words") if max_tokens is None else F.slice("words", 1, max_tokens)
    asked = queries.select("query_id", F.explode(F.array_distinct(words)).alias("token"))
    hay = F.concat_ws("\n", "material_name", "specification", "full_description", "grade")
    rows = cleaned.select("row_id", hay.alias("hay"))
    grams = asked.select("token").distinct().select("token", F.explode(F.array_distinct(T.bigrams(F.col("token")))).alias("gram"))
    held = rows.select("row_id", F.explode(F.array_union(T.bigrams(F.col("hay")), T.chars(F.col("hay")))).alias("gram")).join(
        grams.select("gram").distinct(), "gram", "left_semi")
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(often, "gram", "left").groupBy("token").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).select("token", "g.gram")
    # bigrams and texts of rows are far larger than the size of a file foretells: no side with rows may be broadcast
    hits = held.join(rarest.hint("shuffle_hash"), "gram").select("token", "row_id").distinct().join(rows.hint("merge"), "row_id").where(
        F.contains("hay", F.col("token"))).select("token", "row_id")
    newest = Window.partitionBy("token").orderBy(F.col("row_id").desc())
    hits = hits.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit).drop("n")
    found = asked.join(hits, "token").select("query_id", "row_id").distinct()
    w = Window.partitionBy("query_id").orderBy(F.col("row_id").desc())
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def sort_column(name: str | None) -> str:
    return SORT_FIELDS.get(name, name) if name else DEFAULT_SORT


def page(df: DataFrame, sort: str | None, tie: str, order: str | None = "desc", number: int | None = 1,
         size: int | None = DEFAULT_PAGE_SIZE, query_all: bool = False, near: int | None = None) -> DataFrame:
    """One page in a stable order (``tie`` settles equal sort values); deep pages are found by counting ranges."""
    number = number if number and number >= 1 else 1
    size = size if size and size >= 1 else DEFAULT_PAGE_SIZE
    key = sort_column(sort)
    down = (order or "desc").lower() == "desc"
    if query_all:
        return df.orderBy(F.col(key).desc_nulls_last() if down else F.col(key).asc_nulls_first(), F.col(tie))
    return page_of(df, [(key, down), (tie, False)], (number - 1) * size, size, near)


def project_export(df: DataFrame, taxonomy: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Chosen fields under their display names; unknown fields come out as null."""
    return labelled(with_category_name(df, taxonomy), labels)


def labelled(named: DataFrame, labels: dict[str, str]) -> DataFrame:
    return named.select(*[
        (F.col(f) if f in named.columns else F.lit(None).cast("string")).alias(label) for f, label in labels.items()])


def row_map(raw: DataFrame, header: DataFrame) -> DataFrame:
    """``(title_id, row_id, cells)``: header name to value for non-blank headers; of columns of one name the last counts."""
    last = header.where(~T.is_blank(F.col("name"))).groupBy("title_id", "name").agg(F.max("pos").alias("pos"))
    names = last.groupBy("title_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("names"))
    pairs = F.transform("names", lambda h: F.struct(
        h["name"].alias("name"), F.coalesce(F.get(cells_of(raw), h["pos"] - 1), F.lit("")).alias("value")))
    return raw.join(names, "title_id", "left").select("title_id", "row_id", F.map_from_entries(pairs).alias("cells"))


def row_text(raw: DataFrame) -> Column:
    """Cells joined by `` | ``; a missing cell is written as the word null."""
    return F.array_join(F.transform(cells_of(raw), lambda c: F.coalesce(c, F.lit("null"))), " | ")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row per key, as one aggregate with a map-side step."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")


def first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")


# ---------------------------------------------------------------- cleaned rows by one condition

NO_MATCH = ("UNMATCHED", "FUZZY_AMBIGUOUS")


def _of_file(df: DataFrame, title_id: int | None) -> DataFrame:
    return df if title_id is None else df.where(F.col("title_id") == title_id)


def by_path_prefix(cleaned: DataFrame, prefix: str) -> DataFrame:
    return cleaned.where(F.startswith("category_full_path", F.lit(prefix)))


def by_codes(cleaned: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows whose code is among ``codes(category_code)``."""
    return cleaned.join(codes.select("category_code").distinct(), "category_code", "left_semi")


def by_status(cleaned: DataFrame, *statuses: str) -> DataFrame:
    return cleaned.where(F.col("status").isin(*statuses))


def by_material(cleaned: DataFrame, name_part: str | None = None, code: str | None = None, with_code: bool = False) -> DataFrame:
    out = cleaned if name_part is None else cleaned.where(F.contains("material_name", F.lit(name_part)))
    out = out if code is None else out.where(F.col("material_code") == code)
    return out.where(F.col("material_code") != "") if with_code else out


def unmatched(cleaned: DataFrame, title_id: int | None = None) -> DataFrame:
    return _of_file(cleaned, title_id).where("match_source = 'UNMATCHED'")


def duplicates(cleaned: DataFrame, title_id: int | None = None) -> DataFrame:
    return _of_file(cleaned, title_id).where("is_duplicate = 1")


def low_confidence(cleaned: DataFrame, title_id: int | None = None) -> DataFrame:
    """``(entity_id, sample_type, score)`` of rows whose match is ambiguous or missing."""
    return _of_file(cleaned, title_id).where(F.col("match_source").isin(*NO_MATCH)).select(
        F.col("id").alias("entity_id"), F.lit("LOW_CONFIDENCE").alias("sample_type"), F.col("quality_score").alias("score"))


# ---------------------------------------------------------------- raw rows and files

def rows_of_title(raw: DataFrame, title_id: int, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows of a file in sheet order, all or one page of them.

    A page is a range of places, found by counting the rows of each block of
    the sheet first, so that no task sorts what stands before it.
    """
    rows = raw.where(F.col("title_id") == title_id)
    if limit is None and not offset:
        return rows.orderBy("row_index")
    block = F.floor(F.col("row_index") / 10000)
    sizes = rows.groupBy(block.alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = starts.where(F.col("_before") + F.col("_n") > offset)
    if limit is not None:
        wanted = wanted.where(F.col("_before") < offset + limit)
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("row_index")) - 1
    near = rows.withColumn("_b", block).join(wanted, "_b").withColumn("_place", place).where(F.col("_place") >= offset)
    if limit is not None:
        near = near.where(F.col("_place") < offset + limit)
    return near.orderBy("row_index").drop("_b", "_n", "_before", "_place")


def row_at(raw: DataFrame, title_id: int, row_index: int) -> DataFrame:
    return raw.where((F.col("title_id") == title_id) & (F.col("row_index") == row_index))


def row_by_id(raw: DataFrame, row_id: int) -> DataFrame:
    return raw.where(F.col("row_id") == row_id)


def pending_rows(raw: DataFrame, cleaned: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows that no run has cleaned yet, by file and place; the first ``limit``, if asked for."""
    left = raw.join(cleaned.select("row_id"), "row_id", "left_anti")
    return left if limit is None else left.orderBy("title_id", "row_index").limit(limit)


def last_index(raw: DataFrame) -> DataFrame:
    return raw.groupBy("title_id").agg(F.max("row_index").alias("max_index"))
