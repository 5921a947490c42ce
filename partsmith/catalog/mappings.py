"""Queries over field mapping and result filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from partsmith.catalog.base import query
from partsmith.catalog.cleaned import cleaned, file_keys, parsed, parsed_once
from partsmith.catalog.oracle import cte, field, blank
from partsmith.functions import text as T
from partsmith.operators import ingest, mapping as M, search as Q


def mappings(t):
    keys = file_keys(t)
    return t.keep("mappings", lambda: M.auto_map(t["raw_header"], keys, cleaned(t), t["std_header"]))


def results(t):
    return t.keep("results", lambda: M.fill_all(cleaned(t), mappings(t), parsed_once(t), t["raw_header"], t["std_header"]))


def failed(t):
    return t.keep("failed", lambda: M.failed_rows(cleaned(t), t["raw_rows"], t["std_header"]))


cte("file_field", "raw_header items", """
SELECT title_id, 'temp_data' AS source_type, name AS source, CAST(pos AS INTEGER) AS source_pos FROM raw_header
UNION ALL SELECT * FROM (SELECT title_id, 'extra_data', key, CAST(row_number() OVER (PARTITION BY title_id ORDER BY f, key) AS INTEGER) FROM
 (SELECT title_id, key, min(row_index * 1000 + pos) AS f FROM items GROUP BY title_id, key)) WHERE key <> ''
""")
_a, _b = field("f.source"), field("h.target")
cte("mapping", "file_field std_header cleaned", f"""
WITH w AS (SELECT DISTINCT c.title_id, h.std_id FROM cleaned c JOIN std_header h USING (category_code)),
x AS (SELECT w.title_id, w.std_id, f.source_type, f.source, f.source_pos, h.target, h.pos,
  CASE WHEN {_a} = {_b} THEN 0 WHEN contains({_a}, {_b}) OR contains({_b}, {_a}) THEN 1 END AS kind
  FROM w JOIN file_field f USING (title_id) JOIN std_header h USING (std_id)),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY title_id, std_id, source_type, source ORDER BY kind NULLS LAST, pos) = 1)
SELECT title_id, std_id, source_type, source, source_pos, CASE WHEN kind IS NOT NULL THEN target END AS target, 'auto' AS mapping_type,
  CASE kind WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence, 'pending' AS status FROM b
""")
cte("cell", "raw_rows raw_header", """
SELECT r.title_id, r.row_id, h.name, CASE h.pos WHEN 1 THEN col1 WHEN 2 THEN col2 WHEN 3 THEN col3 WHEN 4 THEN col4 WHEN 5 THEN col5 ELSE col6 END AS value FROM raw_rows r JOIN raw_header h USING (title_id)
""")
cte("fill_value", "mapping cleaned std_header cell items", f"""
WITH m AS (SELECT * FROM mapping WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title_id, std_id, target ORDER BY CASE source_type WHEN 'temp_data' THEN 0 ELSE 1 END, source_pos) = 1),
r AS (SELECT c.title_id, c.row_id, h.std_id, h.pos, h.target, m.source_type, m.source FROM cleaned c JOIN std_header h USING (category_code) JOIN m ON m.title_id = c.title_id AND m.std_id = h.std_id AND m.target = h.target)
SELECT r.title_id, r.row_id, r.std_id, r.pos, r.target,
 CASE WHEN r.source_type = 'extra_data' THEN coalesce(i.value, k.value) ELSE coalesce(k.value, i.value) END AS v0,
 CASE WHEN {blank("v0")} THEN NULL ELSE trim(v0) END AS value
FROM r LEFT JOIN cell k ON k.row_id = r.row_id AND k.name = r.source LEFT JOIN items i ON i.row_id = r.row_id AND i.key = r.source
""")
cte("result", "fill_value", "SELECT title_id, row_id, std_id, " + ", ".join(
    f"max(CASE WHEN pos = {i} THEN value END) AS col{i}" for i in range(1, 7)) + ", 'processed' AS status FROM fill_value GROUP BY title_id, row_id, std_id")
_cols = ", ".join(f"col{i}" for i in range(1, 7))


@query("mp_best_field", "SELECT DISTINCT std_id, source, target FROM mapping")
def _(t):
    fields = mappings(t).select("std_id", "source").distinct()
    return M.best_targets(fields, t["std_header"])


@query("mp_confidence", f"""SELECT DISTINCT f.source, h.target, CASE WHEN {_a} = {_b} THEN 1.0 WHEN contains({_a}, {_b}) OR contains({_b}, {_a}) THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence
 FROM mapping f JOIN std_header h USING (std_id)""")
def _(t):
    pairs = mappings(t).select("std_id", "source").distinct().join(t["std_header"].select("std_id", "target"), "std_id")
    return pairs.select("source", "target").distinct().withColumn("confidence", M.confidence(F.col("source"), F.col("target")))


@query("mp_auto", "SELECT title_id, std_id, source_type, source, source_pos, target, mapping_type, confidence, status FROM mapping")
def _(t):
    return mappings(t)


def manual(t):
    """Take the grade from two sources, map the unit and then drop it, and map the code by hand, twice."""
    keys = mappings(t).select("title_id", "std_id").distinct()

    def edit(seq, target, source, kind):
        return keys.select("title_id", "std_id", F.lit(target).alias("target"), F.lit(source).alias("source"), F.lit(kind).alias("source_type"), F.lit(seq).alias("seq"))

    edits = [edit(1, "牌号", " 牌号，品牌,牌号,", "extra_data"), edit(2, "计量单位", " ", ""), edit(1, "计量单位", "牌号", "extra_data"),
             edit(4, "物料代码", "物料代码", ""), edit(3, "物料代码", "品牌", "temp_data"), edit(2, "物料代码", "规格", "")]
    return reduce(DataFrame.unionByName, edits)


cte("edited_mapping", "mapping", """
SELECT * FROM mapping WHERE target IS DISTINCT FROM '计量单位' AND NOT (target IS NOT DISTINCT FROM '牌号' AND source_type = 'extra_data') AND NOT (target IS NOT DISTINCT FROM '物料代码' AND source_type = 'temp_data')
UNION ALL SELECT DISTINCT title_id, std_id, 'extra_data', '牌号,品牌', CAST(NULL AS INTEGER), '牌号', 'manual', 1.0::DOUBLE, 'approved' FROM mapping
UNION ALL SELECT DISTINCT title_id, std_id, 'temp_data', '物料代码', CAST(NULL AS INTEGER), '物料代码', 'manual', 1.0::DOUBLE, 'approved' FROM mapping
""")


@query("mp_manual_merge", "SELECT title_id, std_id, source_type, source, source_pos, target, mapping_type, confidence, status FROM edited_mapping")
def _(t):
    return M.merge_manual(mappings(t), manual(t))[0]


@query("mp_manual_clear", "SELECT title_id, row_id, std_id, col1, col2, col3, col4, CAST(NULL AS VARCHAR) AS col5, col6 FROM result")
def _(t):
    cleared = M.merge_manual(mappings(t), manual(t))[1]
    return M.clear_columns(results(t), cleared, t["std_header"]).drop("status")


@query("mp_update", """SELECT title_id, std_id, source_type, source, CASE WHEN target IS NULL THEN '规格' ELSE target END AS target, CASE WHEN target IS NULL THEN 'manual' ELSE 'auto' END AS mapping_type,
 CASE WHEN target IS NULL THEN 'approved' ELSE 'pending' END AS status, CASE WHEN target IS NULL THEN TIMESTAMP '2024-06-01 00:00:00' END AS reviewed_at FROM mapping""")
def _(t):
    keys = ["title_id", "std_id", "source_type", "source"]
    edits = mappings(t).where("target is null").select(*keys, F.lit("规格").alias("target"))
    out = M.update_targets(mappings(t), edits, keys, F.expr("TIMESTAMP_NTZ'2024-06-01 00:00:00'"))
    return out.select(*keys, "target", "mapping_type", "status", "reviewed_at")


@query("mp_list", "SELECT title_id, std_id, source, target FROM mapping WHERE title_id = 1 AND status = 'pending' AND source_type = 'extra_data'")
def _(t):
    found = Q.apply_filters(mappings(t), {"title_id": 1, "status": ["pending"], "source_type": ["extra_data"]})
    return found.orderBy("std_id", "source").select("title_id", "std_id", "source", "target")


@query("mp_headers", "SELECT DISTINCT title_id, std_id FROM mapping")
def _(t):
    return mappings(t).select("title_id", "std_id").distinct()


@query("fl_resolve_header", "SELECT c.row_id, h.std_id FROM cleaned c LEFT JOIN (SELECT category_code, min(std_id) AS std_id FROM std_header GROUP BY 1) h USING (category_code)")
def _(t):
    return M.resolve_header(cleaned(t), t["std_header"]).select("row_id", "std_id")


@query("fl_value", "SELECT title_id, row_id, std_id, pos, target, value FROM fill_value")
def _(t):
    return M.fill_long(cleaned(t), mappings(t), parsed_once(t), t["raw_header"], t["std_header"])


@query("fl_fill_all", f"SELECT title_id, row_id, std_id, {_cols}, status FROM result")
def _(t):
    return results(t)


@query("fl_fill", f"SELECT title_id, row_id, std_id, {_cols}, status FROM result WHERE std_id = (SELECT min(std_id) FROM std_header)")
def _(t):
    one = t["std_header"].join(t["std_header"].agg(F.min("std_id").alias("std_id")), "std_id", "left_semi")
    return M.fill_all(cleaned(t), mappings(t), parsed(t), t["raw_header"], one)


@query("fl_fill_counters", f"""SELECT title_id, count(*) FILTER (h.std_id = (SELECT min(std_id) FROM std_header)) AS success, count(*) FILTER ({blank('category_code')}) AS skipped_no_category,
 count(*) FILTER (NOT {blank('category_code')} AND (h.std_id IS NULL OR h.std_id <> (SELECT min(std_id) FROM std_header))) AS skipped_other
 FROM cleaned LEFT JOIN (SELECT category_code, min(std_id) AS std_id FROM std_header GROUP BY 1) h USING (category_code) GROUP BY title_id""")
def _(t):
    return M.fill_counters(cleaned(t), t["std_header"], t["std_header"].agg(F.min("std_id")).scalar())


cte("failed", "cleaned raw_rows std_header", """
SELECT c.title_id, c.row_id, c.category_code, '未找到匹配的标准字段表头（分类编码: '||c.category_code||'）' AS reason, 'FAILED' AS status,
 coalesce(col1,'null')||' | '||coalesce(col2,'null')||' | '||coalesce(col3,'null')||' | '||coalesce(col4,'null')||' | '||coalesce(col5,'null')||' | '||coalesce(col6,'null') AS raw_data
FROM cleaned c JOIN raw_rows r USING (row_id) WHERE c.category_code IS NOT NULL AND c.category_code NOT IN (SELECT category_code FROM std_header)
""")


@query("fl_failed", "SELECT row_id, category_code, reason, status, raw_data FROM failed")
def _(t):
    return failed(t)


@query("join_failed_title", "SELECT row_id, title_id FROM failed")
def _(t):
    return failed(t).select("row_id").join(t["raw_rows"].select("row_id", "title_id"), "row_id")


@query("fl_filled_count", "SELECT row_id, CAST((col1 IS NOT NULL)::INT + (col2 IS NOT NULL)::INT + (col3 IS NOT NULL)::INT + (col4 IS NOT NULL)::INT + (col5 IS NOT NULL)::INT + (col6 IS NOT NULL)::INT AS INTEGER) AS n_filled FROM result")
def _(t):
    return M.filled_count(results(t)).select("row_id", "n_filled")


@query("fl_edit", "SELECT row_id, std_id, CASE WHEN col2 IS NULL THEN '待补' ELSE col2 END AS col2, CASE WHEN col2 IS NULL THEN 'modified' ELSE status END AS status FROM result")
def _(t):
    edits = results(t).where("col2 is null").select("row_id", "std_id", F.lit(2).alias("pos"), F.lit("待补").alias("value"))
    return M.edit_results(results(t), edits).select("row_id", "std_id", "col2", "status")


@query("fl_headers_of_file", """SELECT title_id, std_id, title_id IN (1, 2) AS related FROM (SELECT DISTINCT title_id, std_id FROM result WHERE title_id <> 1
  UNION ALL SELECT 1, min(std_id) FROM std_header)""")
def _(t):
    first = t["std_header"].agg(F.min("std_id").alias("std_id")).withColumn("title_id", F.lit(1).cast("long"))
    return M.header_links(first, results(t).where("title_id = 2"), cleaned(t), t["std_header"])


@query("join_header_link", "SELECT DISTINCT title_id, std_id, TRUE AS related FROM result")
def _(t):
    none = t["std_header"].where("false").select("std_id").withColumn("title_id", F.lit(0).cast("long"))
    return M.header_links(none, results(t), cleaned(t), t["std_header"])


@query("join_anti_unmapped", "SELECT row_id, title_id FROM cleaned WHERE row_id NOT IN (SELECT row_id FROM result)")
def _(t):
    return M.unmapped(cleaned(t), results(t)).select("row_id", "title_id")


@query("join_inner_filled", "SELECT c.title_id, count(*) AS n FROM cleaned c JOIN result r USING (row_id) GROUP BY c.title_id")
def _(t):
    return cleaned(t).select("row_id", "title_id").join(results(t).select("row_id"), "row_id").groupBy("title_id").agg(F.count("*").alias("n"))


@query("flt_search_results", "SELECT row_id, std_id, col1, col2 FROM result WHERE title_id = 3 AND status = 'processed' AND (contains(col1, 'bolt') OR contains(col2, 'bolt') OR contains(col3, 'bolt')) AND (contains(col1, '1') OR contains(col2, '1') OR contains(col3, '1')) ORDER BY row_id LIMIT 20")
def _(t):
    found = Q.search_results(results(t), t["raw_rows"], title_id=3, statuses=("processed",), name_part="bolt", code_part="1")
    return found.orderBy("row_id").limit(20).select("row_id", "std_id", "col1", "col2")
