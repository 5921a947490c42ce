"""Queries over imports and column roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.oracle import trim
from partsmith.operators import ingest
from partsmith.session import new_path
from partsmith.sources import files


@query("src_import", f"""SELECT CAST(7 AS BIGINT) AS title_id, 7 * 1099511627776 + p_partkey AS row_id, p_partkey + 2 AS row_index, {trim('p_name')} AS col1, {trim('p_brand')} AS col2, {trim('p_type')} AS col3, CAST(p_size AS VARCHAR) AS col4,
 regexp_replace(CAST(p_retailprice AS VARCHAR), '\\.0$', '') AS col5 FROM part""")
def _(t):
    return files.import_frame(t["part"], 7, "p_partkey").rows


def sheets(t):
    """Two sheets, of parts and of suppliers, of four CSV files each, with a quoted line break, a blank and a repeated header."""
    out = []
    for title, table, cells in (
            (1, "part", ["cast(p_partkey as string)", "p_name", "concat(p_brand, '\n\"', p_type, '\", x')", "''", "p_name"]),
            (2, "supplier", ["cast(s_suppkey as string)", "s_name", "''", "cast(s_nationkey as string)", "s_name"])):
        path = new_path(t.spark, "sheet")
        key = F.expr(cells[0]).cast("long")
        t[table].repartitionByRange(4, key).sortWithinPartitions(key).selectExpr(*[f"{c} as c{i}" for i, c in enumerate(cells)]).selectExpr(
            "c0 as `编码`", "c1 as `名称`", "c2 as `全描述`", "c3 as ` `", "c4 as `名称 `").write.option("header", True).option(
            "escape", '"').option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
        out.append(files.read_csv(t.spark, path, title))
    return files.together(out)


@query("src_import_csv", """WITH p AS (SELECT 1 AS title_id, row_number() OVER (ORDER BY p_partkey) - 1 AS place, CAST(p_partkey AS VARCHAR) AS col1, p_name AS col2,
   p_brand||chr(10)||'"'||p_type||'", x' AS col3, '' AS col4, p_name AS col5 FROM part
  UNION ALL SELECT 2, row_number() OVER (ORDER BY s_suppkey) - 1, CAST(s_suppkey AS VARCHAR), s_name, '', CAST(s_nationkey AS VARCHAR), s_name FROM supplier)
 SELECT CAST(title_id AS BIGINT) AS title_id, title_id * 1099511627776 + place AS row_id, place + 2 AS row_index, col1, col2, col3, col4, col5 FROM p""")
def _(t):
    return sheets(t).rows


@query("src_import_headers", """SELECT CAST(f.title_id AS BIGINT) AS title_id, h.pos, h.name FROM (VALUES (1), (2)) f(title_id),
 (VALUES (1, '编码'), (2, '名称'), (3, '全描述'), (4, 'col4'), (5, '名称')) h(pos, name)""")
def _(t):
    return sheets(t).header


@query("src_detect_roles", "SELECT title_id, '全描述' AS desc_col, '类别名称' AS category_col FROM raw_title")
def _(t):
    return ingest.detect_roles(t["raw_header"])
