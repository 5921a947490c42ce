"""Queries over exports, purge and clean-up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.cleaned import cleaned
from partsmith.catalog.mappings import failed, results
from partsmith.catalog.searches import batches, log
from partsmith.operators import export as E
from partsmith.session import shared_dir

SPEC = E.ExportSpec(statuses=("export_ready",), filters={"material_name": "bolt"},
                    columns={"id": "编号", "material_name": "物料名称", "category_name": "分类名称", "status": "状态"})
_where = "status = 'export_ready' AND contains(material_name, 'bolt')"
_shown = 'id AS "编号", material_name AS "物料名称", category_name AS "分类名称", status AS "状态"'


@query("snk_export", f"SELECT {_shown} FROM cleaned_log WHERE {_where}")
def _(t):
    return E.export_frame(log(t), t["taxonomy"], SPEC)


def _written(t, fmt: str):
    path = f"{shared_dir(t.spark)}/export-{uuid.uuid4().hex}"
    E.write_export(E.export_frame(log(t), t["taxonomy"], SPEC), path, fmt)
    schema = "`编号` bigint, `物料名称` string, `分类名称` string, `状态` string"
    reader = t.spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


@query("snk_export_csv", f"SELECT {_shown} FROM cleaned_log WHERE {_where}")
def _(t):
    return _written(t, "csv")


@query("snk_export_json", f"SELECT {_shown} FROM cleaned_log WHERE {_where}")
def _(t):
    return _written(t, "json")


@query("snk_export_preview", f"SELECT {_shown} FROM cleaned_log WHERE {_where} ORDER BY id LIMIT 10")
def _(t):
    return E.preview(log(t), t["taxonomy"], SPEC)


@query("snk_export_estimate", f"SELECT count(*) AS n, CAST(count(*) * 200 * 1.5 AS BIGINT) AS bytes FROM cleaned_log WHERE {_where}")
def _(t):
    return E.estimate(log(t), E.ExportSpec(SPEC.category_ids, SPEC.statuses, SPEC.filters, SPEC.columns, "excel"))


def specs(t):
    """Export requests made from orders: every kind, with missing, broken and unknown parts."""
    o, k = t["orders"], F.col("o_custkey")
    kind = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.col("o_orderkey").alias("spec_id"), F.when(k % 7 == 0, " ").otherwise("batch").alias("batch_name"),
        F.when(kind == "1", "by_category").when(kind == "2", "by_status").when(kind == "3", "custom").when(kind == "4", "other").alias("export_type"),
        F.when(F.col("o_orderstatus") == "F", "csv").when(F.col("o_orderstatus") == "P", "xml").alias("format"),
        F.when(k % 3 == 0, "[100101, 5]").when(k % 3 == 1, "[]").alias("category_ids"),
        F.when(k % 3 == 0, '["approved"]').when(k % 3 == 1, "[]").alias("status_list"),
        F.when(k % 3 == 0, '{"unit":"pcs"}').when(k % 3 == 1, "{}").alias("filters"),
        F.when(k % 5 == 0, '["id","nope"]').when(k % 5 == 1, "[]").alias("columns"))


@query("snk_export_validate", """WITH s AS (SELECT o_orderkey AS spec_id, o_custkey AS k, substr(o_orderpriority, 1, 1) AS p, o_orderstatus AS st FROM orders),
 x AS (SELECT spec_id, list_filter([CASE WHEN k % 7 = 0 THEN '批次名称不能为空' END, CASE WHEN p = '5' THEN '导出类型不能为空' END, CASE WHEN p = '4' THEN '不支持的导出类型: other' END,
   CASE WHEN st = 'O' THEN '导出格式不能为空' END, CASE WHEN st = 'P' THEN '不支持的导出格式: xml' END,
   CASE WHEN p = '1' AND k % 3 = 2 THEN '分类导出需要指定分类ID列表' END, CASE WHEN p = '1' AND k % 3 = 1 THEN '分类ID列表不能为空' END,
   CASE WHEN p = '2' AND k % 3 = 2 THEN '状态导出需要指定状态列表' END, CASE WHEN p = '2' AND k % 3 = 1 THEN '状态列表不能为空' END,
   CASE WHEN p = '3' AND k % 3 = 2 THEN '自定义导出需要指定过滤条件' END], lambda e: e IS NOT NULL) AS e,
  list_filter([CASE WHEN p = '1' AND k % 3 = 0 THEN '部分分类不存在或已被删除' END, CASE WHEN p = '3' AND k % 3 = 1 THEN '过滤条件为空，将导出所有数据' END,
   CASE WHEN k % 5 = 1 THEN '包含的列为空，将导出所有字段' END, CASE WHEN k % 5 = 0 THEN '部分字段可能不存在或不可导出: [nope]' END], lambda e: e IS NOT NULL) AS w FROM s)
 SELECT spec_id, len(e) = 0 AS valid, array_to_string(e, ';') AS errors, array_to_string(w, ';') AS warnings FROM x""")
def _(t):
    return E.validate_specs(specs(t), t["taxonomy"]).select(
        "spec_id", "valid", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


@query("snk_result_by_header", """SELECT r.std_id, r.row_id, 0 AS part, h.pos AS place, '原始-'||h.name AS name, c.value FROM result r JOIN raw_header h USING (title_id) JOIN cell c ON c.row_id = r.row_id AND c.name = h.name
 UNION ALL SELECT r.std_id, r.row_id, 1, h.pos, h.target, CASE h.pos WHEN 1 THEN col1 WHEN 2 THEN col2 WHEN 3 THEN col3 WHEN 4 THEN col4 WHEN 5 THEN col5 ELSE col6 END FROM result r JOIN std_header h USING (std_id)""")
def _(t):
    path = f"{shared_dir(t.spark)}/by-header-{uuid.uuid4().hex}"
    E.write_by_header(E.results_by_header(results(t), t["raw_rows"], t["raw_header"], t["std_header"]), path)
    return t.spark.read.parquet(path).select(F.col("std_id").cast("long").alias("std_id"), "row_id", "part", "place", "name", "value")


@query("snk_taxonomy", "SELECT id, category_code, category_name, full_path FROM taxonomy")
def _(t):
    path = f"{shared_dir(t.spark)}/taxonomy-{uuid.uuid4().hex}"
    t["taxonomy"].orderBy("category_code").write.parquet(path)
    return t.spark.read.parquet(path).select("id", "category_code", "category_name", "full_path")


@query("snk_mark_exported", "SELECT id, CASE WHEN status IN ('export_ready','approved') AND export_batch_id IS NULL THEN 999 ELSE export_batch_id END AS export_batch_id FROM cleaned_log")
def _(t):
    taken = E.exportable(log(t)).select("id", F.lit(999).cast("long").alias("batch_id"), (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("at"))
    earlier = taken.select("id", F.lit(1000).cast("long").alias("batch_id"), (F.col("at") - F.expr("INTERVAL 1 DAY")).alias("at"))
    return E.mark_exported(log(t), taken.unionByName(earlier)).select("id", "export_batch_id")


@query("snk_exportable", "SELECT id, status FROM cleaned_log WHERE status IN ('export_ready','approved') AND export_batch_id IS NULL")
def _(t):
    return E.exportable(log(t)).select("id", "status")


@query("snk_purge", """SELECT 'cleaned' AS name, count(*) AS n FROM cleaned WHERE title_id <> 2 UNION ALL SELECT 'results', count(*) FROM result WHERE title_id <> 2
 UNION ALL SELECT 'failed', count(*) FROM failed WHERE title_id <> 2 UNION ALL SELECT 'raw', count(*) FROM raw_rows WHERE title_id <> 2""")
def _(t):
    gone = t["raw_title"].where("status = 'processing'").select("title_id")
    left = E.purge({"cleaned": cleaned(t), "results": results(t), "failed": failed(t), "raw": t["raw_rows"]}, t["raw_rows"], gone)
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("snk_replace_run", "SELECT row_id, title_id, CASE WHEN title_id = 2 THEN 'modified' ELSE status END AS status FROM cleaned")
def _(t):
    from partsmith.sources.files import replace_partitions

    path = f"{shared_dir(t.spark)}/runs-{uuid.uuid4().hex}"
    rows = cleaned(t).select("row_id", "title_id", "status")
    replace_partitions(rows, path)
    replace_partitions(rows.where("title_id = 2").withColumn("status", F.lit("modified")), path)
    return t.spark.read.schema("row_id bigint, status string, title_id bigint").parquet(path).select("row_id", "title_id", "status")


@query("snk_cleanup_exports", "SELECT batch_id FROM export_batches WHERE status IN ('completed','failed','cancelled') AND created_at < TIMESTAMP '1998-06-01' - INTERVAL 365 DAY")
def _(t):
    return E.stale_exports(batches(t), F.expr("TIMESTAMP_NTZ'1998-06-01 00:00:00'"), 365).select("batch_id")
