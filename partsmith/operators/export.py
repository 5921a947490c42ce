"""Exports: selection, preview, validation, purge and clean-up."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from partsmith.functions import scores as S, text as T
from partsmith.operators import search as Q
from partsmith.operators.edits import ORDER
from partsmith.operators.ingest import cells_of

# Known kinds, formats and fields of an export.
KINDS = ("by_category", "by_status", "custom")
FORMATS = ("excel", "csv", "json", "pdf")
FIELDS = ("id", "material_code", "material_name", "specification", "technical_standard", "grade", "unit",
          "category_code", "category_name", "category_full_path", "status", "quality_score", "completeness_score",
          "created_at", "reviewed_at")
BYTES_PER_FIELD = 50
FINAL_BATCH = ("completed", "failed", "cancelled")


@dataclass(frozen=True)
class ExportSpec:
    category_ids: tuple[int, ...] = ()
    statuses: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)
    columns: dict = field(default_factory=dict)
    fmt: str = "csv"


def select_rows(cleaned: DataFrame, spec: ExportSpec) -> DataFrame:
    out = cleaned
    if spec.category_ids:
        out = out.where(F.col("category_id").isin(*spec.category_ids))
    if spec.statuses:
        out = out.where(F.col("status").isin(*spec.statuses))
    return Q.apply_filters(out, spec.filters) if spec.filters else out


def export_frame(cleaned: DataFrame, taxonomy: DataFrame, spec: ExportSpec) -> DataFrame:
    """Selected rows under display names, range-partitioned so files follow id order.

    Names are joined before the rows are put in order, since a join may deal
    them out anew.
    """
    chosen = Q.with_category_name(select_rows(cleaned, spec), taxonomy).repartitionByRange("id").sortWithinPartitions("id")
    return Q.labelled(chosen, spec.columns or {f: f for f in FIELDS})


def write_export(frame: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = frame.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"no writer for {fmt}")


def preview(cleaned: DataFrame, taxonomy: DataFrame, spec: ExportSpec, n: int = 10) -> DataFrame:
    return Q.project_export(select_rows(cleaned, spec).orderBy("id").limit(n), taxonomy, spec.columns or {f: f for f in FIELDS})


def estimate(cleaned: DataFrame, spec: ExportSpec) -> DataFrame:
    """Rows of an export and its estimated size."""
    width = len(spec.columns or FIELDS) * BYTES_PER_FIELD
    factor = S.FORMAT_FACTOR.get(spec.fmt, 1.0)
    return select_rows(cleaned, spec).agg(F.count("*").alias("n")).withColumn(
        "bytes", (F.col("n") * width * F.lit(factor)).cast("long"))


def validate_specs(specs: DataFrame, taxonomy: DataFrame, available: tuple[str, ...] = FIELDS) -> DataFrame:
    """``errors`` and ``warnings`` per spec row.

    ``specs(spec_id, batch_name, export_type, format, category_ids, status_list,
    filters, columns)``; lists and filters are JSON text.
    """
    def when(cond: Column, text) -> Column:
        return F.when(cond, text if isinstance(text, Column) else F.lit(text))

    kind = F.col("export_type")
    ids = F.from_json("category_ids", "array<bigint>")
    states = F.from_json("status_list", "array<string>")
    filters = F.from_json("filters", "map<string,string>")
    cols = F.from_json("columns", "array<string>")
    known = specs.select("spec_id", F.explode(ids).alias("id")).join(taxonomy.select("id"), "id", "left_semi").groupBy(
        "spec_id").agg(F.count("*").alias("_known"))

    def blank(name: str) -> Column:
        return T.is_blank(F.col(name))

    errors = F.array(
        when(blank("batch_name"), "批次名称不能为空"),
        when(blank("export_type"), "导出类型不能为空"),
        when(~blank("export_type") & ~kind.isin(*KINDS), F.concat(F.lit("不支持的导出类型: "), kind)),
        when(blank("format"), "导出格式不能为空"),
        when(~blank("format") & ~F.col("format").isin(*FORMATS), F.concat(F.lit("不支持的导出格式: "), F.col("format"))),
        when((kind == "by_category") & blank("category_ids"), "分类导出需要指定分类ID列表"),
        when((kind == "by_category") & ~blank("category_ids") & ids.isNull(), "分类ID列表格式错误"),
        when((kind == "by_category") & (F.size(ids) == 0), "分类ID列表不能为空"),
        when((kind == "by_status") & blank("status_list"), "状态导出需要指定状态列表"),
        when((kind == "by_status") & ~blank("status_list") & states.isNull(), "状态列表格式错误"),
        when((kind == "by_status") & (F.size(states) == 0), "状态列表不能为空"),
        when((kind == "custom") & blank("filters"), "自定义导出需要指定过滤条件"),
        when((kind == "custom") & ~blank("filters") & filters.isNull(), "过滤条件格式错误"),
    )
    unknown = F.array_except(cols, F.array(*[F.lit(f) for f in available]))
    warnings = F.array(
        when((kind == "by_category") & (F.size(ids) > F.coalesce("_known", F.lit(0))), "部分分类不存在或已被删除"),
        when((kind == "custom") & (F.size(filters) == 0), "过滤条件为空，将导出所有数据"),
        when(F.size(cols) == 0, "包含的列为空，将导出所有字段"),
        when(F.size(unknown) > 0, F.concat(F.lit("部分字段可能不存在或不可导出: ["), F.array_join(unknown, ", "), F.lit("]"))),
    )
    out = specs.join(known, "spec_id", "left")
    kept = [F.filter(e, lambda x: x.isNotNull()) for e in (errors, warnings)]
    return out.select("spec_id", (F.size(kept[0]) == 0).alias("valid"), kept[0].alias("errors"), kept[1].alias("warnings"))


def results_by_header(results: DataFrame, raw: DataFrame, header: DataFrame, std_header: DataFrame) -> DataFrame:
    """Long export per header: raw columns as ``原始-name`` first, then the targets, in order.

    ``(std_id, row_id, part, place, name, value)``: part 0 holds the raw
    columns, part 1 the targets, each with its own places, whatever their number.
    """
    names = header.groupBy("title_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("names"))
    cells = cells_of(raw)
    original = raw.join(names, "title_id").select("row_id", F.transform("names", lambda h: F.struct(
        F.lit(0).alias("part"), h["pos"].alias("place"), F.concat(F.lit("原始-"), h["name"]).alias("name"), F.get(cells, h["pos"] - 1).alias("value"))).alias("orig"))
    targets = std_header.groupBy("std_id").agg(F.sort_array(F.collect_list(F.struct("pos", "target"))).alias("targets"))
    cols = F.array(*[c for c in results.columns if c.startswith("col") and c[3:].isdigit()])
    filled = results.join(targets, "std_id").select("std_id", "row_id", F.transform("targets", lambda h: F.struct(
        F.lit(1).alias("part"), h["pos"].alias("place"), h["target"].alias("name"), F.get(cols, h["pos"] - 1).alias("value"))).alias("done"))
    # both sides have a row per row, whose lists no size of a file foretells: sorted, never broadcast
    return filled.join(original.hint("merge"), "row_id").select("std_id", "row_id", F.inline(F.concat("orig", "done")))


def write_by_header(cells: DataFrame, path: str) -> None:
    """One folder per standard header, its files by name and their rows in order; a large header is cut between rows into several files."""
    cells.repartitionByRange("std_id", "row_id").sortWithinPartitions("std_id", "row_id", "part", "place").write.partitionBy("std_id").parquet(path)


def mark_exported(cleaned: DataFrame, exported: DataFrame) -> DataFrame:
    """Stamp batch and time of ``exported(id, batch_id, at)`` on cleaned rows; of several stamps of a row the latest, by ``seq`` if given."""
    order = F.struct(*([ORDER] if ORDER in exported.columns else []), "at", "batch_id")
    new = exported.groupBy("id").agg(F.max_by(F.struct("batch_id", "at"), order).alias("_new"))
    return cleaned.join(new, "id", "left").withColumns({
        "export_batch_id": F.coalesce("_new.batch_id", "export_batch_id"), "exported_at": F.coalesce("_new.at", "exported_at")}).drop("_new")


def exportable(cleaned: DataFrame) -> DataFrame:
    """Approved or ready rows that no batch has taken yet."""
    return cleaned.where(F.col("status").isin(*S.EXPORTABLE) & (F.coalesce("export_batch_id", F.lit(0)) == 0))


def purge(tables: dict[str, DataFrame], raw: DataFrame, titles: DataFrame) -> dict[str, DataFrame]:
    """Every table without what derives from given files, by file id or by row id."""
    rows = raw.join(titles, "title_id", "left_semi").select("row_id")
    return {
        name: df.join(titles, "title_id", "left_anti") if "title_id" in df.columns else df.join(rows, "row_id", "left_anti")
        for name, df in tables.items()}


def replace_title(old: DataFrame, new: DataFrame, key: str = "title_id") -> DataFrame:
    """The table after a re-run: new rows replace all old rows of the same files."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def stale_exports(batches: DataFrame, now: Column, days: int) -> DataFrame:
    return batches.where(F.col("status").isin(*FINAL_BATCH) & (F.col("created_at") < now - F.expr(f"INTERVAL {days} DAYS")))
