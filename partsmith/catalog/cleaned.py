"""Queries over the cleaning core: parse, clean, score, status, review hand-off."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.oracle import blank, cte, rule_sql, trim
from partsmith.catalog.tables import Tables
from partsmith.config import DEFAULTS
from partsmith.functions import parse as P, scores as S
from partsmith.operators import cleaning, ingest, library, rules, scoring
from partsmith.plans.clean_file import CleanRun, clean_batch, clean_one

CORE_SQL = ", ".join(cleaning.CLEANED_COLUMNS)


def clean_run(t: Tables) -> CleanRun:
    run = clean_batch(t["raw_rows"], t["raw_header"], t["taxonomy"], t["synonyms"])
    return replace(run, cleaned=t.keep("cleaned", lambda: run.cleaned))


def cleaned(t: Tables):
    if "cleaned" not in t._made:
        clean_run(t)
    return t["cleaned"]


def parsed(t: Tables):
    return ingest.parsed_rows(t["raw_rows"], t["raw_header"])


def parsed_once(t):
    """Parsed rows, staged: keys counted right behind their join by file would stay in one task per file."""
    return t.keep("parsed", lambda: parsed(t))


def file_keys(t):
    return t.keep("file_keys", lambda: ingest.first_seen_keys(ingest.items_of(parsed_once(t))))


@query("fn_parse_desc", "SELECT row_id, pos, key, value FROM items")
def _(t):
    return t["raw_rows"].select("row_id", F.inline(P.parse_desc(F.col("col5"))))


_keys = """WITH f AS (SELECT title_id, key, min(row_index * 1000 + pos) AS first_at FROM items WHERE title_id IS NOT NULL GROUP BY ALL)
SELECT title_id, key, CAST(row_number() OVER (PARTITION BY title_id ORDER BY first_at, key) AS INTEGER) AS pos FROM f"""


@query("win_first_seen_keys", _keys)
def _(t):
    return file_keys(t)


_slots = ", ".join(
    f"max(CASE WHEN k.pos = {i} THEN coalesce(i.value, '') END) AS attr{i}" for i in range(1, 21))


@query("cl_extract_attrs", f"""SELECT r.title_id, r.row_id, {_slots}
FROM raw_rows r LEFT JOIN ({_keys}) k ON k.title_id = r.title_id LEFT JOIN items i ON i.row_id = r.row_id AND i.key = k.key GROUP BY r.title_id, r.row_id""")
def _(t):
    return ingest.extract_attrs(t["raw_rows"], t["raw_header"], width=20)  # the sink's columns


@query("cl_parse_test", """SELECT r.row_id, coalesce(string_agg(key||'='||value, '|' ORDER BY pos), '') AS parsed, CAST(count(key) AS INTEGER) AS n_items, TRUE AS success,
  '解析成功，共解析出 '||count(key)||' 个属性' AS message FROM raw_rows r LEFT JOIN items i ON r.row_id = i.row_id GROUP BY r.row_id""")
def _(t):
    return ingest.test_rule(t["raw_rows"].select("row_id", "col5"), "col5").drop("col5")


@query("cl_match_context", f"""SELECT s.row_id, category_name, code_raw AS category_code, material_name, coalesce(string_agg(i.value, '|' ORDER BY pos), '') AS extras
FROM sig s LEFT JOIN items i ON i.row_id = s.row_id GROUP BY ALL""")
def _(t):
    return ingest.match_signals(parsed(t)).withColumn("extras", F.array_join("extras", "|"))


@query("cl_col_by_title", "SELECT row_id, col4 AS brand, col6 AS fallback FROM raw_rows")
def _(t):
    one = ingest.col_by_title(t["raw_header"], t["raw_rows"], "品牌", 1, "brand")
    return ingest.col_by_title(t["raw_header"], one, "不存在的表头", 6, "fallback").select("row_id", "brand", "fallback")


@query("cl_core_fields", "SELECT row_id, material_code, material_name, specification, technical_standard, grade, unit FROM filled")
def _(t):
    return ingest.core_fields(parsed(t)).select("row_id", *cleaning.CORE)


@query("cl_fill_category", "SELECT row_id, category_id, category_code, category_level, category_full_path, category_name FROM filled")
def _(t):
    from partsmith.catalog.matching import outcome

    return cleaning.fill_category(outcome(t).select("row_id", "category_id"), t["taxonomy"])


@query("cl_clean_row", f"SELECT {CORE_SQL} FROM cleaned WHERE title_id = 2")
def _(t):
    ids = t["raw_rows"].where("title_id = 2").select("row_id")
    part = t["raw_rows"].join(ids, "row_id", "left_semi")
    dup_scope = clean_one(part, t["raw_header"], t["taxonomy"], t["synonyms"], ids)
    return dup_scope


@query("cl_clean_batch", f"SELECT {CORE_SQL} FROM cleaned")
def _(t):
    return cleaned(t)


@query("cl_batch_summary", """SELECT title_id, count(*) AS total, count(*) FILTER (match_source <> 'UNMATCHED') AS matched, count(*) FILTER (match_source = 'UNMATCHED') AS unmatched,
 count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'export_ready') AS export_ready,
 CAST(sum(is_duplicate) AS BIGINT) AS duplicates FROM cleaned GROUP BY title_id""")
def _(t):
    c = cleaned(t)
    return c.groupBy("title_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("match_source") != "UNMATCHED").alias("matched"),
        F.count_if(F.col("match_source") == "UNMATCHED").alias("unmatched"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "export_ready").alias("export_ready"), F.sum("is_duplicate").alias("duplicates"))


@query("cl_shard_key", """SELECT row_id, row_id % 4 AS hash_shard, CASE WHEN category_id IS NULL THEN 'UNMATCHED' ELSE coalesce(list_filter(string_split(category_full_path, '/'), lambda x: x <> '')[1], 'UNKNOWN') END AS tree_shard FROM cleaned""")
def _(t):
    return cleaning.shard_key(cleaned(t)).select("row_id", "hash_shard", "tree_shard")


@query("win_dup_flag", "SELECT row_id, source_row_hash, is_duplicate FROM scored")
def _(t):
    base = cleaned(t).select("title_id", "row_id", "row_index", "category_code", "material_code", "specification", "grade",
                             "full_description")
    return scoring.flag_duplicates(base.withColumn("source_row_hash", cleaning.fingerprint())).select(
        "row_id", "source_row_hash", "is_duplicate")


@query("sc_quality", "SELECT row_id, quality_score AS quality, accuracy_score AS accuracy, completeness_score AS completeness FROM scored")
def _(t):
    checked = library.rule_check(cleaned(t), t["taxonomy"], library.build_indexes(t["taxonomy"], t["synonyms"]))
    return checked.select(
        "row_id", F.col("score").alias("quality"), (F.col("score") * 0.8).alias("accuracy"),
        S.completeness(*[F.col(c) for c in cleaning.CORE]).alias("completeness"))


_legacy = " ".join(f"- CASE WHEN {blank(c)} THEN {p} ELSE 0 END" for c, p in
                   [("material_code", 30), ("material_name", 30), ("technical_standard", 20), ("grade", 10), ("unit", 10)])


@query("sc_quality_legacy", f"""SELECT row_id, greatest(0.0, least(100.0, 100 {_legacy} + CASE WHEN category_id IS NULL THEN -20 ELSE 10 END
 + CASE WHEN completeness_score > 80 THEN 10 ELSE 0 END))::DOUBLE AS score FROM scored""")
def _(t):
    c = cleaned(t)
    row = {n: F.col(n) for n in (*cleaning.CORE, "category_id")} | {"completeness": F.col("completeness_score")}
    return c.select("row_id", S.deduction_score(row).alias("score"))


_adaptive = """SELECT title_id, greatest(40.0, least(75.0, quantile_cont({s}, 0.3))) AS review0, greatest(65.0, least(95.0, quantile_cont({s}, 0.7))) AS export0, count(*) AS n
FROM {f} GROUP BY title_id"""


@query("sc_thresholds", f"""WITH q AS ({_adaptive.format(s='completeness_score', f='scored')})
SELECT title_id, CASE WHEN n < 10 THEN 60.0 ELSE review0 END::DOUBLE AS review,
  CASE WHEN n < 10 THEN 80.0 WHEN export0 <= review0 THEN least(95.0, review0 + 5) ELSE export0 END::DOUBLE AS export FROM q""")
def _(t):
    scores = cleaned(t).select("title_id", F.col("completeness_score").alias("score"))
    return scoring.thresholds(scores, "title_id", replace(DEFAULTS, adaptive=True))


@query("win_percentile", """SELECT title_id, quantile_cont(completeness_score, 0.3) AS p30, quantile_cont(completeness_score, 0.7) AS p70,
 quantile_cont(completeness_score, 0.95) AS p95 FROM scored GROUP BY title_id""")
def _(t):
    scores = cleaned(t).select("title_id", F.col("completeness_score").alias("score"))
    return scoring.percentiles(scores, "title_id", {"p30": 0.3, "p70": 0.7, "p95": 0.95}).drop("n")


@query("sc_status", """SELECT row_id, CASE WHEN completeness_score < 60 THEN 'needs_review' WHEN completeness_score >= 80 THEN 'export_ready' ELSE 'approved' END AS status FROM scored""")
def _(t):
    return cleaned(t).select(
        "row_id", S.status_of(F.col("completeness_score"), F.lit(60.0), F.lit(80.0)).alias("status"))


@query("sc_force_review", "SELECT c.row_id, c.status AS forced, CASE WHEN quality_score < 60 THEN 'needs_review' WHEN quality_score >= 80 THEN 'export_ready' ELSE 'approved' END AS parity FROM cleaned c")
def _(t):
    c = cleaned(t).drop("status")
    forced = scoring.with_status(c).withColumnRenamed("status", "forced")
    return scoring.with_status(forced, cfg=replace(DEFAULTS, force_review=False)).select(
        "row_id", "forced", F.col("status").alias("parity"))


@query("sc_review_tasks", """SELECT row_id AS entity_id, title_id, 'data_validation' AS task_type, 'medium' AS priority, 'pending' AS status, '数据验证: '||coalesce(material_name, '') AS title,
 '质量评分过低: '||quality_score AS description FROM cleaned WHERE quality_score < 60""")
def _(t):
    return scoring.review_tasks(cleaned(t), F.lit(60.0))


@query("sc_low_conf", """SELECT 'LOW_CONFIDENCE' AS sample_type, row_id AS entity_id, full_description AS source_text, category_name AS source_category_name, category_code AS source_category_code,
 category_id AS target_category_id, match_confidence AS confidence, quality_score AS score, 'AI 分类检测低置信/未匹配' AS reason, 'pending' AS status
 FROM cleaned WHERE quality_score < 95 AND match_source IN ('UNMATCHED','FUZZY_AMBIGUOUS') AND NOT is_duplicate = 1""")
def _(t):
    c = cleaned(t)
    earlier = c.where("is_duplicate = 1").select(F.col("row_id").alias("entity_id"), F.lit("LOW_CONFIDENCE").alias("sample_type"))
    return scoring.low_confidence(c, earlier, F.lit(95.0), F.col("match_source").isin("UNMATCHED", "FUZZY_AMBIGUOUS"))


cte("rule_table", "region", """SELECT r_regionkey AS rule_id, r_name AS rule_name, CASE r_regionkey WHEN 0 THEN NULL WHEN 1 THEN ':' WHEN 2 THEN '=' WHEN 3 THEN '->' ELSE '|' END AS kv_sep,
 CASE r_regionkey WHEN 0 THEN NULL WHEN 1 THEN ';' WHEN 2 THEN ',' WHEN 3 THEN '*' ELSE '//' END AS item_sep, CAST(NULL AS VARCHAR) AS escape, CAST(NULL AS BOOLEAN) AS trim,
 CAST(NULL AS BOOLEAN) AS ignore_empty, r_regionkey <> 2 AS is_active, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM region""")


def rule_table(t):
    return t["region"].selectExpr(
        "cast(r_regionkey as long) AS rule_id", "r_name AS rule_name", "CASE r_regionkey WHEN 0 THEN NULL WHEN 1 THEN ':' WHEN 2 THEN '=' WHEN 3 THEN '->' ELSE '|' END AS kv_sep",
        "CASE r_regionkey WHEN 0 THEN NULL WHEN 1 THEN ';' WHEN 2 THEN ',' WHEN 3 THEN '*' ELSE '//' END AS item_sep", "cast(NULL as string) AS escape",
        "cast(NULL as boolean) AS trim", "cast(NULL as boolean) AS ignore_empty", "r_regionkey <> 2 AS is_active", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS created_at")


@query("cl_rules_active", "SELECT CAST(rule_id AS BIGINT) AS rule_id, rule_name, coalesce(kv_sep, ' ') AS kv_sep, coalesce(item_sep, ';') AS item_sep FROM rule_table WHERE is_active")
def _(t):
    return rules.active_rules(rule_table(t)).select("rule_id", "rule_name", "kv_sep", "item_sep")


@query("udf_rules", """WITH r AS (SELECT p_partkey, p_brand, p_size, coalesce(k.kv_sep, ' ') AS kv, coalesce(k.item_sep, ';') AS item FROM part LEFT JOIN rule_table k ON k.rule_id = p_partkey % 6 AND k.is_active)
 SELECT p_partkey AS row_id, 0 AS pos, 'brand' AS key, p_brand AS value FROM r UNION ALL SELECT p_partkey, 1, 'size', CAST(p_size AS VARCHAR) FROM r UNION ALL SELECT p_partkey, 2, '', 'loose' FROM r""")
def _(t):
    filled = rules.with_defaults(rule_table(t).where("is_active")).select("rule_id", "kv_sep", "item_sep")
    texts = t["part"].selectExpr("p_partkey AS row_id", "p_partkey % 6 AS rule_id", "p_brand", "p_size").join(filled, "rule_id", "left").selectExpr(
        "row_id", "rule_id", "coalesce(kv_sep, ' ') AS k", "coalesce(item_sep, ';') AS i", "p_brand", "p_size").selectExpr(
        "row_id", "rule_id", "concat('brand', k, p_brand, i, ' size ', k, p_size, i, i, 'loose') AS text")
    texts = texts.withColumn("text", F.regexp_replace("text", "size  ", "size "))
    return rules.parse_rows(texts, rule_table(t), "text").select("row_id", F.inline("items"))
