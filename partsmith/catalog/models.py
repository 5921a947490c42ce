"""Queries over model requests and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.cleaned import cleaned, parsed
from partsmith.catalog.libraries import indexes, recalled, recheck_input
from partsmith.catalog.oracle import blank, code, cte, field, rule_sql, trim
from partsmith.operators import library as L, model_io as M

cte("verdict", "responses rechecked code_idx taxonomy raw_rows", f"""
WITH v AS (SELECT p.row_id, p.kind, k.score AS r_score, k.consistent, k.best_code AS r_code, k.best_name AS r_name, k.reason AS r_reason, r.col1 FROM responses p JOIN rechecked k USING (row_id) JOIN raw_rows r USING (row_id)),
w AS (SELECT row_id, kind, CASE kind WHEN 'plain' THEN 92.0 WHEN 'fenced' THEN 55.0 WHEN 'escape' THEN 70.0 WHEN 'against' THEN 30.0 WHEN 'range' THEN 100.0 WHEN 'recode' THEN 20.0 ELSE r_score END::DOUBLE AS score,
 CASE WHEN kind IN ('plain','escape','against') THEN TRUE WHEN kind = 'text' THEN consistent ELSE FALSE END AS matched,
 CASE kind WHEN 'plain' THEN coalesce(col1, '') WHEN 'fenced' THEN '100101' WHEN 'escape' THEN '' WHEN 'against' THEN '100102' WHEN 'range' THEN 'ZZ' WHEN 'recode' THEN '100101' ELSE r_code END AS best_code,
 CASE kind WHEN 'plain' THEN '名称一致 '||coalesce(col1, '') WHEN 'fenced' THEN '应为 100101' WHEN 'escape' THEN '牌号 45\\C' WHEN 'against' THEN '系统分类正确' WHEN 'range' THEN '无' WHEN 'recode' THEN '应为 100101' ELSE 'AI 失败，'||r_reason END AS reason, r_name FROM v)
SELECT w.row_id, w.score, w.matched, w.best_code, CASE WHEN w.kind = 'text' THEN w.r_name ELSE t.category_name END AS best_name, w.reason
FROM w LEFT JOIN code_idx i ON i.code_norm = {code('w.best_code')} LEFT JOIN taxonomy t ON t.id = i.category_id
""")


def verdicts(t):
    checked = L.rule_check(recheck_input(t), t["taxonomy"], indexes(t))
    return t.keep("verdicts", lambda: M.parse_detect(t["responses"], checked, indexes(t), t["taxonomy"]))


@query("ml_parse_detect", "SELECT row_id, score, matched, best_code, best_name, reason FROM verdict")
def _(t):
    return verdicts(t)


_endorsed = f"(NOT {blank('v.reason')} AND ((NOT {blank('v.best_code')} AND contains(v.reason, v.best_code)) OR (NOT {blank('v.best_name')} AND contains(v.reason, v.best_name)) IS TRUE))"


@query("ml_reconcile", f"""WITH a AS (SELECT v.*, c.category_code AS own, s.category_id AS sys FROM verdict v JOIN cleaned c USING (row_id) LEFT JOIN code_idx s ON s.code_norm = {code('c.category_code')}),
 b AS (SELECT v.row_id, v.score, v.matched, v.reason, v.own, v.sys, CASE WHEN {blank('v.best_code')} OR (v.matched AND v.best_code IS DISTINCT FROM v.own AND NOT coalesce({_endorsed}, FALSE)) THEN NULL ELSE v.best_code END AS bc FROM a v),
 c AS (SELECT b.*, i.category_id AS bid, k.category_code AS top FROM b LEFT JOIN code_idx i ON i.code_norm = {code('b.bc')} LEFT JOIN recalled k ON k.row_id = b.row_id AND k.rank = 1),
 d AS (SELECT *, CASE WHEN sys IS NULL THEN FALSE WHEN bid IS NULL THEN matched ELSE sys = bid END AS consistent FROM c)
 SELECT row_id, score, consistent, CASE WHEN consistent OR coalesce(sys = bid, FALSE) THEN NULL WHEN sys IS NULL AND bc IS NULL THEN top ELSE bc END AS suggested_code, reason FROM d""")
def _(t):
    return M.reconcile(verdicts(t), cleaned(t), recalled(t), indexes(t), t["taxonomy"])


cte("recat_in", "cleaned verdict code_idx", f"""
SELECT c.*, v.score AS v_score, v.reason AS v_reason, v.best_code AS v_code, i.category_id AS target_id FROM cleaned c JOIN verdict v USING (row_id)
LEFT JOIN code_idx i ON v.score < 60 AND NOT v.matched AND NOT {blank('v.best_code')} AND v.best_code IS DISTINCT FROM c.category_code AND coalesce({_endorsed}, FALSE) AND i.code_norm = {code('v.best_code')}
""")


@query("ml_recategorise", f"""SELECT row_id, CASE WHEN ok THEN target_id ELSE category_id END AS category_id, CASE WHEN ok THEN best_code ELSE category_code END AS category_code, CASE WHEN ok THEN score ELSE v_score END AS quality_score,
 CASE WHEN ok THEN 'AI 辅助重分类：'||best_name||'（原 '||coalesce(category_code, '')||'）；'||v_reason ELSE v_reason END AS reason FROM (SELECT *, target_id IS NOT NULL AND score > v_score AS ok FROM ({rule_sql('recat_in', 'target_id')}) z) y""")
def _(t):
    return M.recategorise(cleaned(t), verdicts(t), indexes(t), t["taxonomy"])


@query("ml_detect_requests", """WITH l AS (SELECT r.row_id, string_agg(r.category_code||' | '||t.category_name||' | '||t.full_path||coalesce(' | '||t.description, ''), chr(10) ORDER BY rank) AS c FROM recalled r JOIN taxonomy t ON t.id = r.category_id GROUP BY r.row_id)
 SELECT c.row_id, '物料代码：'||coalesce(material_code,'')||chr(10)||'物料名称：'||material_name||chr(10)||'规格：'||specification||chr(10)||'牌号：'||grade||chr(10)||'技术标准：'||technical_standard||chr(10)||'计量单位：'||unit||chr(10)||'全描述：'||coalesce(full_description,'')||chr(10)
 ||'分类编码：'||coalesce(category_code,'')||chr(10)||'分类路径：'||coalesce(category_full_path,'')||chr(10)||'候选：'||chr(10)||coalesce(l.c,'')||chr(10)||'系统分类编码 '||coalesce(category_code,'')||CASE WHEN category_code IS NOT NULL THEN ' 存在于标准库中，但仍须依据物料内容独立判断其是否正确。' ELSE ' 不在标准库中，请从候选中选出正确编码。' END AS prompt
 FROM cleaned c LEFT JOIN l USING (row_id)""")
def _(t):
    return M.detect_requests(cleaned(t), recalled(t), t["taxonomy"], indexes(t))


@query("ml_extract_requests", f"""WITH h AS (SELECT category_code, string_agg(target, '、' ORDER BY pos) AS fields FROM std_header GROUP BY category_code),
 n AS (SELECT category_name, min(category_code) AS category_code FROM taxonomy GROUP BY category_name),
 x AS (SELECT r.row_id, r.col5, coalesce(c.category_code, t.category_code, n.category_code) AS category_code FROM raw_rows r JOIN cleaned c USING (row_id) LEFT JOIN code_idx i ON i.code_norm = {code('r.col2')} LEFT JOIN taxonomy t ON t.id = i.category_id LEFT JOIN n ON n.category_name = {trim('r.col2')})
 SELECT row_id, '目标字段：'||h.fields||chr(10)||'描述：'||col5 AS prompt FROM x JOIN h USING (category_code) WHERE NOT {blank('col5')}""")
def _(t):
    return M.extract_requests(parsed(t), cleaned(t), t["std_header"], indexes(t), t["taxonomy"])


cte("extracted", "cleaned raw_rows std_header", """
WITH r AS (SELECT c.row_id, r.title_id, r.col3, r.col4, r.col6 FROM cleaned c JOIN raw_rows r USING (row_id) WHERE c.category_code IN (SELECT category_code FROM std_header) AND r.col5 <> '')
SELECT row_id, title_id, '物资名称' AS target, col4 AS value FROM r UNION ALL SELECT row_id, title_id, '规格', col3 FROM r UNION ALL SELECT row_id, title_id, '牌号', '' FROM r UNION ALL SELECT row_id, title_id, '计量单位', col6 FROM r
""")


def extracted(t):
    return t.keep("extracted", lambda: M.parse_extract(t["extract_responses"], cleaned(t), t["std_header"]))


@query("ml_parse_extract", "SELECT row_id, target, value FROM extracted")
def _(t):
    return extracted(t)


@query("ml_extract_collect", "SELECT title_id, row_id, target AS key, value FROM extracted")
def _(t):
    return M.collect_extracted(extracted(t), t["extract_responses"], t["raw_rows"].select("row_id", "title_id"))[0]


@query("ml_extract_counters", """SELECT r.title_id, count(*) FILTER (r.row_id IN (SELECT row_id FROM extracted)) AS success, count(*) FILTER (r.row_id NOT IN (SELECT row_id FROM extracted)) AS error FROM raw_rows r GROUP BY r.title_id""")
def _(t):
    return M.collect_extracted(extracted(t), t["extract_responses"], t["raw_rows"].select("row_id", "title_id"))[1]
