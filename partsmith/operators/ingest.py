"""Reading headed tables, picking column roles and turning rows into signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from partsmith.config import (ATTR_GRADE, ATTR_NAME, ATTR_SHORT_NAME, ATTR_SPEC, ATTR_STANDARD, ATTR_UNIT,
                              CATEGORY_HEADERS, DESC_HEADERS, HEADER_MATERIAL_CODE, ParseRule)
from partsmith.functions import text as T
from partsmith.functions.parse import item_value, item_values, parse_desc
from partsmith.session import stage


def header_names(names: list[str | None], max_cols: int | None = None) -> list[str]:
    """Trimmed header names; a blank one becomes ``colN``.  ``max_cols`` keeps the first ones only, if asked for."""
    return [(n or "").strip() or f"col{i}" for i, n in enumerate(names[:max_cols], 1)]


def import_cells(df: DataFrame, order: list[str], max_cols: int | None = None) -> DataFrame:
    """Cells as text (of the first ``max_cols`` columns, if asked for), without rows whose cells are all blank.

    ``order`` are key columns that are kept and give a row its place.
    """
    cells = [c for c in df.columns if c not in order][:max_cols]
    out = df.select(*order, *[T.cell_text(F.col(c)).alias(f"col{i}") for i, c in enumerate(cells, 1)])
    filled = F.exists(F.array(*[f"col{i}" for i in range(1, len(cells) + 1)]), lambda c: c != "")
    return out.where(filled)


def _last_match(words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.col("name"), F.lit(w))
    return F.max_by(F.when(hit, F.col("name")), F.when(hit, F.col("pos")))


def detect_roles(header: DataFrame) -> DataFrame:
    """``(title_id, desc_col, category_col)``: the last matching header of each kind."""
    return header.groupBy("title_id").agg(
        _last_match(DESC_HEADERS).alias("desc_col"), _last_match(CATEGORY_HEADERS).alias("category_col"))


def column_positions(header: DataFrame) -> DataFrame:
    """Per file, the 1-based positions the cleaning rules read from."""
    roles = detect_roles(header)

    def first_containing(word: str, default: int) -> Column:
        return F.coalesce(F.min(F.when(F.contains(F.col("name"), F.lit(word)), F.col("pos"))), F.lit(default))

    return header.join(roles, "title_id").groupBy("title_id").agg(
        F.min(F.when(F.col("name") == F.col("desc_col"), F.col("pos"))).alias("desc_pos"),
        F.min(F.when(F.col("name") == F.col("category_col"), F.col("pos"))).alias("category_pos"),
        first_containing(HEADER_MATERIAL_CODE, 3).alias("code_pos"),
        first_containing(ATTR_UNIT, 6).alias("unit_pos"),
    )


def cells_of(raw: DataFrame) -> Column:
    n = sum(1 for c in raw.columns if c.startswith("col") and c[3:].isdigit())
    return F.array(*[f"col{i}" for i in range(1, n + 1)])


def col_by_title(header: DataFrame, raw: DataFrame, word: str, default: int, out: str) -> DataFrame:
    """Value of the first column whose header contains ``word``, else of column ``default``."""
    pos = header.groupBy("title_id").agg(
        F.coalesce(F.min(F.when(F.contains(F.col("name"), F.lit(word)), F.col("pos"))), F.lit(default)).alias("_pos"))
    return raw.join(pos, "title_id", "left").withColumn(
        out, F.get(cells_of(raw), F.coalesce("_pos", F.lit(default)) - 1)).drop("_pos")


def parsed_rows(raw: DataFrame, header: DataFrame, rule: ParseRule = ParseRule()) -> DataFrame:
    """Raw rows with description, parsed items and the cells that roles point at.

    The per-file positions are one row per file; AQE broadcasts them when they
    are small and splits the join of an oversized file otherwise.
    """
    cells = cells_of(raw)

    def at(pos: str) -> Column:
        return F.get(cells, F.col(pos) - 1)

    return (
        raw.join(column_positions(header), "title_id", "left")
        .withColumn("full_description", F.when(F.col("desc_pos").isNotNull(), at("desc_pos")).otherwise(F.lit("")))
        .withColumn("items", parse_desc(F.col("full_description"), rule))
        .withColumn("declared_category", at("category_pos"))
        .withColumn("header_code", F.get(cells, F.coalesce("code_pos", F.lit(3)) - 1))
        .withColumn("header_unit", F.get(cells, F.coalesce("unit_pos", F.lit(6)) - 1))
    )


def material_name_of(items: Column) -> Column:
    return F.coalesce(item_value(items, ATTR_NAME), item_value(items, ATTR_SHORT_NAME), F.lit(""))


def signal_columns() -> dict[str, Column]:
    """What the matcher reads of a parsed row."""
    name = F.when(T.is_blank(F.col("declared_category")), F.col("col2")).otherwise(F.col("declared_category"))
    return {"category_name": name, "category_code": F.col("col1"), "extras": item_values(F.col("items")), "material_name": material_name_of(F.col("items"))}


def match_signals(parsed: DataFrame) -> DataFrame:
    """``(row_id, category_name, category_code, extras, material_name)`` for the matcher."""
    return parsed.select("row_id", *[c.alias(name) for name, c in signal_columns().items()])


def core_fields(parsed: DataFrame) -> DataFrame:
    """Add the six core fields; only an absent attribute falls through, not an empty one."""
    items = F.col("items")
    empty = F.lit("")
    return parsed.withColumns({
        "material_code": F.col("header_code"),
        "material_name": material_name_of(items),
        "specification": F.coalesce(item_value(items, ATTR_SPEC), empty),
        "technical_standard": F.coalesce(item_value(items, ATTR_STANDARD), empty),
        "grade": F.coalesce(item_value(items, ATTR_GRADE), empty),
        "unit": F.coalesce(item_value(items, ATTR_UNIT), F.col("header_unit")),
    })


# ---------------------------------------------------------------- extracted attributes

def attr_items(raw: DataFrame, header: DataFrame, rule: ParseRule = ParseRule()) -> DataFrame:
    """Long form ``(title_id, row_id, row_index, pos, key, value)`` of all parsed items."""
    return items_of(parsed_rows(raw, header, rule))


def items_of(parsed: DataFrame) -> DataFrame:
    return parsed.where(~T.is_blank(F.col("full_description"))).select("title_id", "row_id", "row_index", F.inline("items"))


def first_seen_keys(items: DataFrame, cap: int | None = None) -> DataFrame:
    """``(title_id, key, pos)``: keys of a file in order of first appearance, all or the first ``cap``.

    The first place of each key is a map-side aggregate, so the ranking sees
    one row per key of a file and not the rows of the file.
    """
    first = items.groupBy("title_id", "key").agg(F.min(F.struct("row_index", "pos")).alias("at"))
    w = Window.partitionBy("title_id").orderBy("at", "key")
    ranked = first.withColumn("pos", F.row_number().over(w)).select("title_id", "key", "pos")
    return ranked if cap is None else ranked.where(F.col("pos") <= cap)


def extract_attrs(raw: DataFrame, header: DataFrame, rule: ParseRule = ParseRule(),
                  width: int | None = None) -> DataFrame:
    """Wide ``(title_id, row_id, attr1..attrN)`` with an empty text for an absent key.

    N is the largest number of keys of a file, unless a sink asks for ``width``
    columns; the long form (:func:`attr_items`) is never cut.

    Rows are parsed once and staged.  Key order is per file (one short list,
    joined by file); every item of a row looks up its slot, and the columns
    pick the items by slot, so rows are never exploded and regrouped.
    """
    parsed = stage(parsed_rows(raw, header, rule).select("title_id", "row_id", "row_index", "full_description", "items"), "parsed-items")
    keys = stage(first_seen_keys(
        parsed.where(~T.is_blank(F.col("full_description"))).select(
            "title_id", "row_id", "row_index", F.inline("items"))), "first-seen-keys")
    if width is None:
        width = keys.agg(F.max("pos")).first()[0] or 0
    listed = keys.groupBy("title_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "key"))), lambda k: k["key"]).alias("keys"))
    slotted = parsed.join(listed, "title_id", "left").select(
        "title_id", "row_id", F.size("keys").alias("n"), item_values(F.col("items")).alias("values"),
        F.transform("items", lambda p: F.array_position(F.col("keys"), p["key"])).alias("slots"))

    def column(i: int) -> Column:
        at = F.array_position("slots", F.lit(i).cast("long"))
        value = F.when(at > 0, F.get("values", (at - 1).cast("int"))).otherwise(F.lit(""))
        return F.when(F.col("n") >= i, value).alias(f"attr{i}")

    return slotted.select("title_id", "row_id", *[column(i) for i in range(1, width + 1)])


def test_rule(samples: DataFrame, text: str, rule: ParseRule = ParseRule()) -> DataFrame:
    """Dry run of a rule: parsed items as text, their number and a message."""
    items = parse_desc(F.col(text), rule)
    shown = F.array_join(F.transform(items, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "|")
    return samples.withColumns({
        "parsed": shown, "n_items": F.size(items), "success": F.lit(True),
        "message": F.concat(F.lit("解析成功，共解析出 "), F.size(items).cast("string"), F.lit(" 个属性")),
    })
