"""Source fields to standard header targets, and filling the targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partsmith.functions import text as T
from partsmith.operators.edits import ORDER, last_edits
from partsmith.operators.ingest import cells_of
from partsmith.operators.search import row_text

FAILED_REASON = ("未找到匹配的标准字段表头（分类编码: ", "）")
RAW, EXTRA = "temp_data", "extra_data"


def confidence(source: Column, target: Column) -> Column:
    a, b = T.norm_field(source), T.norm_field(target)
    return (
        F.when(source.isNull() | target.isNull(), 0.0).when(a == b, 1.0)
        .when(T.contains_either(a, b), 0.8).otherwise(0.3))


def best_targets(sources: DataFrame, std_header: DataFrame) -> DataFrame:
    """Add ``target`` to ``sources(std_id, source)``: equal first, else the first containment.

    Joined on the header, whose targets are a short list; nothing pairs across
    headers.
    """
    a, b = T.norm_field(F.col("source")), T.norm_field(F.col("target"))
    kind = F.when(a == b, 0).when(T.contains_either(a, b), 1)
    hits = (
        sources.select("std_id", "source").distinct()
        .join(std_header.where("target is not null").select("std_id", "pos", "target"), "std_id")
        .withColumn("kind", kind).where("kind is not null")
        .groupBy("std_id", "source").agg(F.min(F.struct("kind", "pos", "target")).alias("best"))
        .select("std_id", "source", F.col("best.target").alias("target")))
    return sources.join(hits, ["std_id", "source"], "left")


def auto_map(header: DataFrame, attr_keys: DataFrame, cleaned: DataFrame, std_header: DataFrame) -> DataFrame:
    """Map every raw header and extracted attribute of a file to each header of its categories.

    The best target depends on the header's targets and the field name only, so
    it is found once per (header, field) and joined back per file.
    """
    codes = cleaned.where(~T.is_blank(F.col("category_code"))).select("title_id", "category_code").distinct()
    heads = std_header.groupBy("category_code").agg(F.min("std_id").alias("std_id"))
    wanted = codes.join(heads, "category_code").select("title_id", "std_id").distinct()
    fields = header.where(~T.is_blank(F.col("name"))).select(
        "title_id", F.lit(RAW).alias("source_type"), F.col("name").alias("source"), F.col("pos").alias("source_pos")
    ).unionByName(attr_keys.where(~T.is_blank(F.col("key"))).select(
        "title_id", F.lit(EXTRA).alias("source_type"), F.col("key").alias("source"), F.col("pos").alias("source_pos")))
    mapped = best_targets(wanted.join(fields, "title_id"), std_header)
    return mapped.select(
        "title_id", "std_id", "source_type", "source", "source_pos", "target", F.lit("auto").alias("mapping_type"),
        confidence(F.col("source"), F.col("target")).alias("confidence"), F.lit("pending").alias("status"))


def merge_manual(mappings: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``edits(title_id, std_id, target, source, source_type)``.

    Edits are applied one after the other, by ``seq`` if given.  A blank source
    removes every mapping of its target; any other edit replaces the mapping of
    the same target and source type.  Returns the mappings and the cleared
    ``(title_id, std_id, target)``.
    """
    keys = ["title_id", "std_id", "target"]
    order = F.struct(*([ORDER] if ORDER in edits.columns else []), F.coalesce("source", F.lit("")))
    typed = edits.where(~T.is_blank(F.col("target"))).withColumn(
        "source_type", F.when(T.is_blank(F.col("source_type")), RAW).otherwise(F.col("source_type"))).withColumn("_order", order)
    cleared = typed.where(T.is_blank(F.col("source"))).groupBy(*keys).agg(F.max("_order").alias("_cleared"))
    fresh = typed.where(~T.is_blank(F.col("source"))).withColumn("source", T.split_multi(F.col("source"))).where("source <> ''").join(
        cleared, keys, "left").where("_cleared is null or _order > _cleared").groupBy(*keys, "source_type").agg(F.max_by("source", "_order").alias("source"))
    cleared = cleared.select(*keys)
    kept = mappings.join(cleared, keys, "left_anti").join(fresh.select(*keys, "source_type"), [*keys, "source_type"], "left_anti")
    manual = fresh.select(
        "title_id", "std_id", "source_type", "source", F.lit(None).cast("int").alias("source_pos"), "target",
        F.lit("manual").alias("mapping_type"), F.lit(1.0).alias("confidence"), F.lit("approved").alias("status"))
    return kept.unionByName(manual), cleared


def update_targets(mappings: DataFrame, edits: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Set the target of given mappings by hand: approved, with a review time."""
    edits = last_edits(edits.select(*keys, *[c for c in ("target", "seq") if c in edits.columns]), keys)
    joined = mappings.join(edits.withColumnRenamed("target", "_t").withColumn("_e", F.lit(True)), keys, "left")
    return joined.withColumns({
        "target": F.when(F.col("_e"), F.col("_t")).otherwise(F.col("target")),
        "mapping_type": F.when(F.col("_e"), "manual").otherwise(F.col("mapping_type")),
        "status": F.when(F.col("_e"), "approved").otherwise(F.col("status")),
        "reviewed_at": F.when(F.col("_e"), now).otherwise(
            F.col("reviewed_at") if "reviewed_at" in mappings.columns else F.lit(None)),
    }).drop("_t", "_e")


def resolve_header(cleaned: DataFrame, std_header: DataFrame, default: Column | None = None) -> DataFrame:
    """Add ``std_id`` by category code; null when the category has no header."""
    heads = std_header.groupBy("category_code").agg(F.min("std_id").alias("std_id"))
    out = cleaned.join(heads, "category_code", "left")
    return out if default is None else out.withColumn("std_id", F.coalesce("std_id", default))


def _row_values(raw: DataFrame, items: str) -> DataFrame:
    """Per row its cells by position and its attributes by key."""
    attrs = F.map_from_entries(F.transform(items, lambda p: F.struct(p["key"], p["value"])))
    return raw.select("title_id", "row_id", cells_of(raw).alias("cells"), attrs.alias("attrs"))


def plan_targets(mappings: DataFrame, std_header: DataFrame, header: DataFrame) -> DataFrame:
    """``(title_id, std_id, plan)``: per target in order, its source type and its sources.

    The first mapping of a target wins.  Source names are cut apart and led to
    the position of the first column of that name here, once per file and
    header, so that rows only read arrays.  One entry per target of a header.
    """
    order = F.struct(
        (F.col("mapping_type") != "manual").alias("o"), F.when(F.col("source_type") == RAW, 0).otherwise(1).alias("t"),
        F.coalesce("source_pos", F.lit(0)).alias("p"), "source_type", "source")
    best = mappings.where("target is not null").groupBy("title_id", "std_id", "target").agg(F.min(order).alias("m")).select(
        "title_id", "std_id", "target", "m.source_type", "m.source")
    firsts = header.where("name is not null").groupBy("title_id", "name").agg(F.min("pos").alias("cell"))
    cut = best.select("title_id", "std_id", "target", F.posexplode(F.split("source", "[,，]")).alias("i", "name"))
    sources = cut.withColumn("name", T.jtrim(F.col("name"))).where("name <> ''").join(firsts, ["title_id", "name"], "left").groupBy(
        "title_id", "std_id", "target").agg(F.sort_array(F.collect_list(F.struct("i", "name", "cell"))).alias("sources"))
    entries = best.join(sources, ["title_id", "std_id", "target"], "left").join(
        std_header.select("std_id", "target", "pos"), ["std_id", "target"])
    return entries.groupBy("title_id", "std_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "target", "source_type", "sources"))).alias("plan"))


def value_of(entry: Column, cells: Column, attrs: Column) -> Column:
    """Sources of one target: declared type first, then raw, then extracted; blanks dropped."""
    def one(source: Column) -> Column:
        raw_v, attr_v = F.get(cells, source["cell"] - 1), F.try_element_at(attrs, source["name"])
        return F.when(entry["source_type"] == EXTRA, F.coalesce(attr_v, raw_v)).otherwise(F.coalesce(raw_v, attr_v))

    values = F.filter(F.transform(entry["sources"], lambda n: T.jtrim(one(n))), lambda v: v.isNotNull() & (v != ""))
    return F.nullif(F.array_join(values, ","), F.lit(""))


def fill_long(cleaned: DataFrame, mappings: DataFrame, parsed: DataFrame, header: DataFrame,
              std_header: DataFrame) -> DataFrame:
    """``(title_id, row_id, std_id, pos, target, value)`` for every row with a header.

    Row values travel as an array and a map next to the row, the plan as a
    short array joined per (file, header): one row-sized join, no explode by source.
    """
    rows = resolve_header(cleaned.select("title_id", "row_id", "category_code"), std_header).where("std_id is not null")
    joined = rows.join(plan_targets(mappings, std_header, header), ["title_id", "std_id"]).join(
        _row_values(parsed, "items"), ["title_id", "row_id"])
    return joined.select("title_id", "row_id", "std_id", F.explode("plan").alias("e"), "cells", "attrs").select(
        "title_id", "row_id", "std_id", "e.pos", "e.target", value_of(F.col("e"), F.col("cells"), F.col("attrs")).alias("value"))


def fill_all(cleaned: DataFrame, mappings: DataFrame, parsed: DataFrame, header: DataFrame, std_header: DataFrame,
             width: int | None = None) -> DataFrame:
    """Wide results ``(title_id, row_id, std_id, col1..colN, status)`` over all headers at once.

    N is the last position of any header, unless a sink asks for ``width`` columns.
    """
    if width is None:
        width = std_header.agg(F.max("pos")).first()[0] or 0
    rows = resolve_header(cleaned.select("title_id", "row_id", "category_code"), std_header).where("std_id is not null")
    joined = rows.join(plan_targets(mappings, std_header, header), ["title_id", "std_id"]).join(
        _row_values(parsed, "items"), ["title_id", "row_id"])
    valued = joined.select(
        "title_id", "row_id", "std_id", F.transform("plan", lambda e: e["pos"]).alias("places"),
        F.transform("plan", lambda e: value_of(e, F.col("cells"), F.col("attrs"))).alias("values"))

    def column(i: int) -> Column:
        at = F.array_position("places", F.lit(i))
        return F.when(at > 0, F.get("values", (at - 1).cast("int"))).alias(f"col{i}")

    return valued.select("title_id", "row_id", "std_id", *[column(i) for i in range(1, width + 1)], F.lit("processed").alias("status"))


def fill_counters(cleaned: DataFrame, std_header: DataFrame, std_id: Column) -> DataFrame:
    """Counters of filling one header: filled, without category, of another header."""
    rows = resolve_header(cleaned, std_header)
    no_category = T.is_blank(F.col("category_code"))
    return rows.groupBy("title_id").agg(
        F.count_if(~no_category & (F.col("std_id") == std_id)).alias("success"),
        F.count_if(no_category).alias("skipped_no_category"),
        F.count_if(~no_category & (F.col("std_id").isNull() | (F.col("std_id") != std_id))).alias("skipped_other"))


def failed_rows(cleaned: DataFrame, raw: DataFrame, std_header: DataFrame) -> DataFrame:
    """Rows with a category that has no header: reason and raw text."""
    orphan = cleaned.where(~T.is_blank(F.col("category_code"))).join(
        std_header.select("category_code").distinct(), "category_code", "left_anti")
    reason = F.concat(F.lit(FAILED_REASON[0]), "category_code", F.lit(FAILED_REASON[1]))
    return orphan.select("row_id", "category_code", reason.alias("reason"), F.lit("FAILED").alias("status")).join(
        raw.select("row_id", row_text(raw).alias("raw_data")), "row_id")


def filled_count(results: DataFrame) -> DataFrame:
    cols = [c for c in results.columns if c.startswith("col") and c[3:].isdigit()]
    return results.withColumn("n_filled", F.size(F.filter(F.array(*cols), lambda v: ~T.is_blank(v))))


def clear_columns(results: DataFrame, cleared: DataFrame, std_header: DataFrame) -> DataFrame:
    """Blank the result columns of targets whose mapping was removed."""
    gone = cleared.join(std_header.select("std_id", "target", "pos"), ["std_id", "target"]).groupBy(
        "title_id", "std_id").agg(F.collect_set("pos").alias("_gone"))
    cols = [c for c in results.columns if c.startswith("col") and c[3:].isdigit()]
    return results.join(gone, ["title_id", "std_id"], "left").withColumns({
        c: F.when(F.array_contains("_gone", int(c[3:])), None).otherwise(F.col(c)) for c in cols}).drop("_gone")


def edit_results(results: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply ``edits(row_id, std_id, pos, value)``: the row becomes modified."""
    edits = last_edits(edits, ["row_id", "std_id", "pos"])
    by_row = edits.groupBy("row_id", "std_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("_e"))
    cols = [c for c in results.columns if c.startswith("col") and c[3:].isdigit()]

    def edited(c: str) -> Column:
        pos = F.lit(int(c[3:]))
        hit = F.coalesce(F.map_contains_key("_e", pos), F.lit(False))
        return F.when(hit, F.try_element_at("_e", pos)).otherwise(F.col(c))

    return results.join(by_row, ["row_id", "std_id"], "left").withColumns(
        {**{c: edited(c) for c in cols}, "status": F.when(F.col("_e").isNotNull(), "modified").otherwise(F.col("status"))}
    ).drop("_e")


def header_links(links: DataFrame, results: DataFrame, cleaned: DataFrame, std_header: DataFrame) -> DataFrame:
    """``(title_id, std_id, related)``: stored links, else from results, else from category codes."""
    stored = links.select("title_id", "std_id").distinct()
    from_results = results.select("title_id", "std_id").distinct().join(
        stored.select("title_id").distinct(), "title_id", "left_anti")
    known = stored.unionByName(from_results)
    loose = resolve_header(
        cleaned.where(~T.is_blank(F.col("category_code"))).select("title_id", "category_code").distinct(), std_header
    ).where("std_id is not null").select("title_id", "std_id").join(
        known.select("title_id").distinct(), "title_id", "left_anti")
    return known.withColumn("related", F.lit(True)).unionByName(loose.withColumn("related", F.lit(False)))


def unmapped(cleaned: DataFrame, results: DataFrame) -> DataFrame:
    return cleaned.join(results.select("row_id"), "row_id", "left_anti")
