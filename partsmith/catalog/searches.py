"""Queries over filters, joins, windows, sorting and paging."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.cleaned import cleaned
from partsmith.catalog.oracle import words
from partsmith.catalog.tables import Tables
from partsmith.functions import text as T
from partsmith.operators import search as Q

DAY = dt.datetime(2024, 1, 2)


def log(t: Tables):
    """Cleaned rows with the times and batch a workbench would have recorded."""
    def at(day: int):
        return F.expr(f"timestampadd(MINUTE, row_id, TIMESTAMP_NTZ'2024-01-0{day} 00:00:00')")

    exported = (F.col("status") == "export_ready") & (F.col("specification") != "")
    return t.keep("cleaned_log", lambda: cleaned(t).withColumns({
        "id": F.col("row_id"), "created_at": at(1),
        "reviewed_at": F.when((F.col("status") != "needs_review") & (F.col("is_duplicate") == 0), at(2)),
        "exported_at": F.when(exported, at(3)), "export_batch_id": F.when(exported, F.col("title_id") + 100)}))


def batches(t: Tables):
    o = t["orders"]
    kind = F.substring("o_orderpriority", 1, 1)
    records = F.col("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("batch_id"), F.concat(F.lit("batch "), F.col("o_orderkey").cast("string")).alias("batch_name"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "processing").otherwise("failed").alias("status"),
        F.when(kind == "1", "excel").when(kind == "2", "csv").when(kind == "3", "json").otherwise("pdf").alias("format"),
        F.when(F.col("o_custkey") % 2 == 0, "category").otherwise("status").alias("batch_type"),
        F.concat(F.lit("user"), (F.col("o_custkey") % 20).cast("string")).alias("created_by"),
        F.rint(records).cast("long").alias("total_records"),
        F.when(F.col("o_orderstatus") == "F", F.rint(records).cast("long")).otherwise(0).cast("long").alias("exported_records"),
        F.when(F.col("o_orderstatus") == "F", F.rint(records * 50).cast("long")).alias("file_size"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_custkey") % 5 + 100).alias("run_id"))


_search = Q.CleanedSearch(category_level=3, path_prefix="/11", material_name="o", specification="1",
                          statuses=("export_ready", "needs_review"), created=(DAY, None), exportable=True)
_where = """category_level = 3 AND (starts_with(category_code, '/11') OR starts_with(category_full_path, '/11')) AND contains(material_name, 'o') AND contains(specification, '1')
 AND status IN ('export_ready','needs_review') AND created_at >= TIMESTAMP '2024-01-02' AND status IN ('export_ready','approved')"""
_cols = ("id", "title_id", "category_code", "material_code", "material_name", "specification", "status", "created_at")


@query("flt_search_cleaned", f"SELECT {', '.join(_cols)}, category_name FROM cleaned_log WHERE {_where} ORDER BY created_at DESC, id LIMIT 20 OFFSET 20")
def _(t):
    found = Q.with_category_name(Q.search_cleaned(log(t), _search), t["taxonomy"])
    return Q.page(found, "createdAt", "id", "desc", 2, 20).select(*_cols, "category_name")


@query("flt_count_cleaned", f"SELECT count(*) AS n FROM cleaned_log WHERE {_where}")
def _(t):
    return Q.count_cleaned(log(t), _search)


@query("flt_custom", "SELECT id, material_name, category_level, status FROM cleaned_log WHERE contains(material_name, 'bolt') AND category_level = 3 AND status IN ('approved','export_ready')")
def _(t):
    found = Q.apply_filters(log(t), {"material_name": "bolt", "category_level": 3, "status": ["approved", "export_ready"]})
    return found.select("id", "material_name", "category_level", "status")


@query("flt_path_prefix", "SELECT id, category_full_path FROM cleaned_log WHERE starts_with(category_full_path, '/12/12')")
def _(t):
    return Q.by_path_prefix(log(t), "/12/12").select("id", "category_full_path")


@query("flt_code", "SELECT c.id, c.category_code FROM cleaned_log c WHERE category_code IN (SELECT max(category_code) FROM taxonomy WHERE level = 3 GROUP BY parent_id)")
def _(t):
    wanted = t["taxonomy"].where("level = 3").groupBy("parent_id").agg(F.max("category_code").alias("category_code"))
    return Q.by_codes(log(t), wanted).select("id", "category_code")


@query("flt_status", "SELECT id, status FROM cleaned_log WHERE status = 'needs_review'")
def _(t):
    return Q.by_status(log(t), "needs_review").select("id", "status")


@query("flt_material", "SELECT id, material_code, material_name FROM cleaned_log WHERE contains(material_name, 'ring') AND material_code <> ''")
def _(t):
    return Q.by_material(log(t), "ring", with_code=True).select("id", "material_code", "material_name")


@query("flt_unmatched", "SELECT id, title_id, match_source FROM cleaned_log WHERE match_source = 'UNMATCHED'")
def _(t):
    return Q.unmatched(log(t)).select("id", "title_id", "match_source")


@query("flt_duplicates", "SELECT id, title_id, source_row_hash FROM cleaned_log WHERE is_duplicate = 1")
def _(t):
    return Q.duplicates(log(t)).select("id", "title_id", "source_row_hash")


def low_samples(t: Tables):
    """Samples of rows whose match is ambiguous or missing."""
    return Q.low_confidence(log(t))


@query("flt_low_conf", "SELECT id AS entity_id, quality_score AS score FROM cleaned_log WHERE match_source IN ('UNMATCHED','FUZZY_AMBIGUOUS') AND title_id = 3")
def _(t):
    return Q.low_confidence(log(t), 3).select("entity_id", "score")


@query("flt_of_file", """SELECT 'unmatched' AS kind, id FROM cleaned_log WHERE match_source = 'UNMATCHED' AND title_id = 2
 UNION ALL SELECT 'duplicate', id FROM cleaned_log WHERE is_duplicate = 1 AND title_id = 2""")
def _(t):
    return Q.unmatched(log(t), 2).select(F.lit("unmatched").alias("kind"), "id").unionByName(
        Q.duplicates(log(t), 2).select(F.lit("duplicate").alias("kind"), "id"))


@query("flt_any_keyword", f"""WITH q AS (SELECT id AS query_id, category_name FROM taxonomy WHERE level = 2),
 a AS (SELECT DISTINCT query_id, unnest(({words('category_name')})[1:6]) AS token FROM q),
 h AS (SELECT DISTINCT a.query_id, c.row_id FROM a JOIN cleaned_log c ON contains(c.material_name, token) OR contains(c.specification, token) OR contains(c.full_description, token) OR contains(c.grade, token))
 SELECT query_id, row_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY row_id DESC) AS INTEGER) AS place FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY row_id DESC) <= 200""")
def _(t):
    asked = t["taxonomy"].where("level = 2").select(F.col("id").alias("query_id"), T.tokens(F.col("category_name")).alias("words"))
    return Q.any_keyword(log(t), asked, 200, 6)


@query("prj_display", """SELECT id AS "编号", material_name AS "物料名称", category_name AS "分类名称", status AS "状态", CAST(NULL AS VARCHAR) AS "备注" FROM cleaned_log""")
def _(t):
    return Q.project_export(log(t), t["taxonomy"], {
        "id": "编号", "material_name": "物料名称", "category_name": "分类名称", "status": "状态", "remark": "备注"})


@query("prj_snapshot", """SELECT row_id, '分类编码='||coalesce(col1,'')||';类别名称='||coalesce(col2,'')||';物料代码='||coalesce(col3,'')||';品牌='||coalesce(col4,'')||';全描述='||coalesce(col5,'')||';计量单位='||coalesce(col6,'') AS cells,
 coalesce(col1,'null')||' | '||coalesce(col2,'null')||' | '||coalesce(col3,'null')||' | '||coalesce(col4,'null')||' | '||coalesce(col5,'null')||' | '||coalesce(col6,'null') AS text FROM raw_rows""")
def _(t):
    raw = t["raw_rows"]
    shown = F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    maps = Q.row_map(raw, t["raw_header"]).select("row_id", shown.alias("cells"))
    return maps.join(raw.select("row_id", Q.row_text(raw).alias("text")), "row_id")


# ---------------------------------------------------------------- joins

@query("join_category_name", "SELECT c.id, t.category_name FROM cleaned_log c LEFT JOIN taxonomy t ON c.category_id = t.id")
def _(t):
    return Q.with_category_name(log(t), t["taxonomy"]).select("id", "category_name")


@query("join_raw_cleaned_extra", """SELECT r.row_id, c.category_code, c.status, i.n_items FROM raw_rows r LEFT JOIN cleaned c ON c.row_id = r.row_id
 LEFT JOIN (SELECT row_id, count(*) AS n_items FROM items GROUP BY row_id) i ON i.row_id = r.row_id""")
def _(t):
    from partsmith.operators.ingest import attr_items

    newest = Q.latest(cleaned(t).select("row_id", "category_code", "status", "row_index"), ["row_id"], "row_index")
    items = attr_items(t["raw_rows"], t["raw_header"]).groupBy("row_id").agg(F.count("*").alias("n_items"))
    return t["raw_rows"].select("row_id").join(newest.drop("row_index"), "row_id", "left").join(items, "row_id", "left")


@query("join_semi_title", "SELECT c.row_id, c.status FROM cleaned c WHERE row_id IN (SELECT row_id FROM raw_rows WHERE title_id IN (SELECT title_id FROM raw_title WHERE status = 'completed'))")
def _(t):
    done = t["raw_title"].where("status = 'completed'").select("title_id")
    rows = t["raw_rows"].join(done, "title_id", "left_semi").select("row_id")
    return cleaned(t).join(rows, "row_id", "left_semi").select("row_id", "status")


@query("join_export_batches", """SELECT batch_id, status FROM export_batches WHERE run_id IN
 (SELECT export_batch_id FROM cleaned_log WHERE category_id IN (SELECT id FROM taxonomy WHERE level = 3 AND parent_id = (SELECT min(id) FROM taxonomy WHERE level = 2)))""")
def _(t):
    tax = t["taxonomy"]
    parent = tax.where("level = 2").agg(F.min("id")).scalar()
    wanted = tax.where((F.col("level") == 3) & (F.col("parent_id") == parent)).select(F.col("id").alias("category_id"))
    runs = log(t).join(wanted, "category_id", "left_semi").select(F.col("export_batch_id").alias("run_id")).where("run_id is not null").distinct()
    return batches(t).join(runs, "run_id", "left_semi").select("batch_id", "status")


# ---------------------------------------------------------------- windows, sorts, pages

@query("win_latest", "SELECT source_row_hash, max(row_id) AS row_id, arg_max(title_id, row_id) AS title_id FROM cleaned GROUP BY source_row_hash")
def _(t):
    return Q.latest(cleaned(t).select("source_row_hash", "row_id", "title_id").withColumn("o", F.col("row_id")), ["source_row_hash"], "o").drop("o")


@query("win_first", "SELECT category_code, min(std_id) AS std_id FROM std_header GROUP BY category_code")
def _(t):
    heads = t["std_header"].select("category_code", "std_id").withColumn("o", F.col("std_id"))
    return Q.first(heads, ["category_code"], "o").drop("o")


@query("srt_page", "SELECT id, material_code FROM cleaned_log ORDER BY material_code DESC NULLS LAST, id LIMIT 50 OFFSET 100")
def _(t):
    return Q.page(log(t), "materialCode", "id", "desc", 3, 50).select("id", "material_code")


@query("srt_deep_page", "SELECT id, material_code FROM cleaned_log ORDER BY material_code DESC NULLS LAST, id LIMIT 50 OFFSET 1000")
def _(t):
    return Q.page(log(t), "materialCode", "id", "desc", 21, 50, near=200).select("id", "material_code")


@query("srt_tree", "SELECT id, CAST(row_number() OVER (ORDER BY level, category_code) AS INTEGER) AS pos FROM taxonomy")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("level").orderBy("category_code")
    sizes = t["taxonomy"].groupBy("level").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.level") < F.col("a.level"), "left").groupBy(F.col("a.level").alias("level")).agg(
        F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return t["taxonomy"].withColumn("n", F.row_number().over(w)).join(before, "level").select(
        "id", (F.col("n") + F.col("before")).cast("int").alias("pos"))


@query("lim_recent", "SELECT batch_id, created_at FROM export_batches ORDER BY created_at DESC, batch_id DESC LIMIT 20")
def _(t):
    return batches(t).orderBy(F.col("created_at").desc(), F.col("batch_id").desc()).limit(20).select("batch_id", "created_at")


@query("lim_history", "SELECT batch_id, status, format, created_at FROM export_batches WHERE created_by = 'user3' AND status = 'failed' AND created_at >= TIMESTAMP '1996-01-01' ORDER BY created_at DESC, batch_id LIMIT 20 OFFSET 20")
def _(t):
    found = Q.apply_filters(batches(t), {"status": ["failed"], "created_by": "user3"}).where("created_by = 'user3'").where(
        Q.all_of(Q.between("created_at", (dt.datetime(1996, 1, 1), None))))
    return Q.page(found, "createdAt", "batch_id", "desc", 2, 20).select("batch_id", "status", "format", "created_at")


# ---------------------------------------------------------------- raw rows and files

@query("src_by_title", "SELECT row_id, row_index FROM raw_rows WHERE title_id = 2 ORDER BY row_index LIMIT 50 OFFSET 50")
def _(t):
    return Q.rows_of_title(t["raw_rows"], 2, 50, 50).select("row_id", "row_index")


@query("src_rows", """SELECT 'at' AS kind, row_id, row_index FROM raw_rows WHERE title_id = 2 AND row_index = (SELECT min(row_index) FROM raw_rows WHERE title_id = 2)
 UNION ALL SELECT 'id', row_id, row_index FROM raw_rows WHERE row_id = 42 UNION ALL SELECT 'pending', row_id, row_index FROM raw_rows WHERE title_id <> 1""")
def _(t):
    raw = t["raw_rows"]
    first = raw.where("title_id = 2").agg(F.min("row_index")).first()[0]
    done = raw.where("title_id = 1").select("row_id")
    parts = {"at": Q.row_at(raw, 2, first), "id": Q.row_by_id(raw, 42), "pending": Q.pending_rows(raw, done)}
    out = [df.select(F.lit(k).alias("kind"), "row_id", "row_index") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("src_max_index", "SELECT title_id, max(row_index) AS max_index FROM raw_rows GROUP BY title_id")
def _(t):
    return Q.last_index(t["raw_rows"])


@query("src_files", "SELECT title_id, file_name, created_at FROM raw_title WHERE contains(file_name, 'file') AND status = 'completed' AND created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01' ORDER BY created_at DESC LIMIT 10")
def _(t):
    found = t["raw_title"].where(
        F.contains("file_name", F.lit("file")) & (F.col("status") == "completed")
        & F.col("created_at").between(dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)))
    return found.orderBy(F.col("created_at").desc()).limit(10).select("title_id", "file_name", "created_at")
