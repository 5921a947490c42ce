"""DuckDB SQL for the checks: text helpers, shared CTEs and the assembler.

The SQL is written on its own terms: nested loops over all pairs where the
Spark side uses blocked joins, window functions where it uses aggregates.
"""

from __future__ import annotations

import re

from partsmith.catalog.views import TABLES, VIEWS


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x01-\x20]+|[\x01-\x20]+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {trim(x)} = '')"


def norm(x: str) -> str:
    return rf"nullif(regexp_replace(lower({trim(x)}), '[()（）\[\]【】{{}}/\-\s\x0b_]+', '', 'g'), '')"


def code(x: str) -> str:
    return rf"nullif(regexp_replace({trim(x)}, '[\s\x0b\-_/]+', '', 'g'), '')"


def field(x: str) -> str:
    return rf"regexp_replace(lower(coalesce({x}, '')), '[\s\x0b]+', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '[^a-zA-Z0-9一-龥]+'), lambda w: w <> '')"


def grams(x: str) -> str:
    return f"list_distinct([substr({x}, i, 2) FOR i IN range(1, greatest(length({x}) - 1, 1) + 1)])"


def jaccard(x: str, y: str) -> str:
    a, b = f"lower({trim(x)})", f"lower({trim(y)})"
    return (f"CASE WHEN {x} IS NULL OR {y} IS NULL OR {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE "
            f"ELSE len(list_intersect({grams(a)}, {grams(b)}))::DOUBLE / len(list_distinct(list_concat({grams(a)}, {grams(b)}))) END")


def either(x: str, y: str) -> str:
    return f"(contains({x}, {y}) OR contains({y}, {x}))"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, reads: str, sql: str) -> None:
    CTES[name] = (tuple(reads.split()), sql)


for _name, (_deps, _sql) in VIEWS.items():
    CTES[_name] = (_deps, _sql.format(**{d: d for d in _deps}))


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with every shared CTE it mentions, directly or through another one."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name in TABLES:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {head},\n{re.sub(r'^WITH (RECURSIVE )?', '', body)}"
    return f"WITH RECURSIVE {head}\n{body}"


# ---------------------------------------------------------------- parsing

cte("items", "raw_rows", f"""
WITH cut AS (
  SELECT title_id, row_id, row_index, unnest(string_split(col5, ';')) AS it, generate_subscripts(string_split(col5, ';'), 1) AS ord
  FROM raw_rows WHERE col5 IS NOT NULL),
kept AS (SELECT title_id, row_id, row_index, ord, {trim('it')} AS it FROM cut WHERE {trim('it')} <> ''),
kv AS (SELECT title_id, row_id, row_index, ord,
   CASE WHEN contains(it, ' ') THEN {trim("substr(it, 1, instr(it, ' ') - 1)")} ELSE '' END AS key,
   CASE WHEN contains(it, ' ') THEN {trim("substr(it, instr(it, ' ') + 1)")} ELSE it END AS value FROM kept),
one AS (SELECT title_id, row_id, row_index, key, min(ord) AS first_at, arg_max(value, ord) AS value FROM kv GROUP BY ALL)
SELECT title_id, row_id, row_index, CAST(row_number() OVER (PARTITION BY row_id ORDER BY first_at) - 1 AS INTEGER) AS pos, key, value FROM one
""")
cte("attr", "raw_rows items", """
SELECT r.row_id,
  max(CASE WHEN key = '物资名称' THEN value END) AS a_name, max(CASE WHEN key = '物资简称' THEN value END) AS a_short,
  max(CASE WHEN key = '规格' THEN value END) AS a_spec, max(CASE WHEN key = '技术标准号' THEN value END) AS a_std,
  max(CASE WHEN key = '牌号' THEN value END) AS a_grade, max(CASE WHEN key = '计量单位' THEN value END) AS a_unit
FROM raw_rows r LEFT JOIN items i ON r.row_id = i.row_id GROUP BY r.row_id
""")
cte("sig", "raw_rows attr", f"""
SELECT r.row_id, r.title_id, r.col2 AS category_name, r.col1 AS code_raw, {norm('r.col2')} AS name_norm, {code('r.col1')} AS code_norm,
  coalesce(a_name, a_short, '') AS material_name, CASE WHEN {blank("coalesce(a_name, a_short, '')")} THEN NULL ELSE coalesce(a_name, a_short, '') END AS mat_raw,
  {norm("coalesce(a_name, a_short, '')")} AS mat_norm
FROM raw_rows r JOIN attr USING (row_id)
""")
cte("signal", "sig items", f"""
SELECT row_id, 0 AS kind, name_norm AS norm FROM sig WHERE name_norm IS NOT NULL
UNION ALL SELECT DISTINCT row_id, 1, {norm('value')} FROM items WHERE {norm('value')} IS NOT NULL
UNION ALL SELECT row_id, 2, mat_norm FROM sig WHERE mat_norm IS NOT NULL
""")

# ---------------------------------------------------------------- matcher as nested loops

cte("cat", "taxonomy", f"SELECT *, {norm('category_name')} AS cn FROM taxonomy")
cte("textpair", "signal cat", f"""
WITH n AS (SELECT DISTINCT norm, {grams('norm')} AS ng FROM (SELECT DISTINCT norm FROM signal) s),
c AS (SELECT DISTINCT cn, {grams('cn')} AS cg FROM (SELECT DISTINCT cn FROM cat WHERE cn IS NOT NULL) s),
p AS (SELECT norm, cn, CASE WHEN norm = cn THEN 0 WHEN {either('norm', 'cn')} THEN 1 ELSE 2 END AS rel,
   len(list_intersect(ng, cg))::DOUBLE / (len(ng) + len(cg) - len(list_intersect(ng, cg))) AS sim FROM n CROSS JOIN c)
SELECT norm, cn, rel, CASE WHEN rel = 2 THEN sim ELSE 1.0 END AS sim FROM p WHERE rel < 2 OR sim >= 0.55
""")
cte("closure", "taxonomy", """
SELECT p.id AS ancestor_id, c.id AS l3_id, 1 AS hops, c.parent_id AS via_id FROM taxonomy c JOIN taxonomy p ON c.parent_id = p.id WHERE c.level = 3 AND p.level <> 3
UNION ALL
SELECT g.id, c.id, 2, c.parent_id FROM taxonomy c JOIN taxonomy p ON c.parent_id = p.id JOIN taxonomy g ON p.parent_id = g.id WHERE c.level = 3 AND p.level <> 3 AND g.level <> 3
""")
cte("syn_name", "sig synonyms closure cat", f"""
WITH s AS (SELECT id AS syn_id, category_id AS target_id, CASE WHEN {blank('synonym_norm')} THEN {norm('synonym_name')} ELSE lower({trim('synonym_norm')}) END AS sn
           FROM synonyms WHERE category_id IS NOT NULL AND NOT {blank('synonym_name')}),
t AS (SELECT ancestor_id AS target_id, l3_id, hops, via_id FROM closure UNION ALL SELECT id, id, 0, NULL FROM cat WHERE level = 3),
h AS (SELECT n.name_norm, s.syn_id, CASE WHEN c.cn = n.name_norm THEN 0 WHEN {either('c.cn', 'n.name_norm')} THEN 1 ELSE 2 END AS fit, t.hops, t.via_id, t.l3_id
      FROM (SELECT DISTINCT name_norm FROM sig WHERE name_norm IS NOT NULL) n JOIN s ON s.sn = n.name_norm JOIN t USING (target_id) JOIN cat c ON c.id = t.l3_id)
SELECT name_norm, l3_id AS category_id FROM h QUALIFY row_number() OVER (PARTITION BY name_norm ORDER BY syn_id, fit, hops, via_id, l3_id) = 1
""")
cte("anc_score", "sig cat textpair", """
WITH k AS (SELECT DISTINCT name_norm, code_norm FROM sig),
s AS (SELECT k.name_norm, k.code_norm, c.id AS ancestor_id,
   CASE WHEN t.rel = 0 THEN 1.0 WHEN t.rel = 1 THEN 0.8 WHEN t.sim >= 0.7 THEN 0.6::DOUBLE + 0.3::DOUBLE * t.sim ELSE 0.0 END AS by_name,
   CASE WHEN k.code_norm = c.category_code THEN 1.0 WHEN starts_with(c.category_code, k.code_norm) THEN 0.7 ELSE 0.0 END AS by_code
   FROM k JOIN cat c ON c.level IN (1, 2) LEFT JOIN textpair t ON t.norm = k.name_norm AND t.cn = c.cn)
SELECT name_norm, code_norm, ancestor_id, greatest(coalesce(by_name, 0.0), coalesce(by_code, 0.0))::DOUBLE AS score FROM s
WHERE greatest(coalesce(by_name, 0.0), coalesce(by_code, 0.0)) >= 0.7
""")
cte("boost", "anc_score closure", """
SELECT name_norm, code_norm, l3_id AS category_id, max(score * 0.2::DOUBLE) AS boost FROM anc_score JOIN closure USING (ancestor_id) GROUP BY ALL
""")
cte("text_score", "sig signal textpair cat syn_name", """
WITH e AS (
  SELECT s.row_id, s.kind, c.id AS category_id, t.rel,
    CASE WHEN s.kind = 0 THEN CASE WHEN t.rel = 0 THEN 1.0::DOUBLE WHEN t.rel = 1 THEN 0.85::DOUBLE WHEN t.sim >= 0.7 THEN 0.6::DOUBLE + 0.3::DOUBLE * t.sim END
         ELSE CASE WHEN t.rel = 0 THEN 0.9::DOUBLE WHEN t.rel = 1 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE + 0.3::DOUBLE * t.sim END END AS score
  FROM signal s JOIN textpair t USING (norm) JOIN cat c ON c.cn = t.cn AND c.level = 3
  JOIN sig g ON g.row_id = s.row_id WHERE g.name_norm IS NULL OR g.name_norm NOT IN (SELECT name_norm FROM syn_name))
SELECT row_id, category_id, score,
  CASE kind WHEN 1 THEN 'EXTRA_NAME' WHEN 2 THEN 'MATERIAL_NAME' ELSE CASE rel WHEN 0 THEN 'NAME_EXACT' WHEN 1 THEN 'NAME_FUZZY' ELSE 'SEMANTIC' END END AS source
FROM e WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY row_id, category_id ORDER BY score DESC, kind) = 1
""")
cte("code_score", "sig cat syn_name text_score", """
SELECT s.row_id, c.id AS category_id, CASE WHEN s.code_raw = c.category_code THEN 1.0 ELSE 0.6 END::DOUBLE AS score,
  CASE WHEN s.code_raw = c.category_code THEN 'CODE_EXACT' ELSE 'CODE_PREFIX' END AS source
FROM sig s JOIN cat c ON c.level = 3 AND (s.code_raw = c.category_code OR starts_with(c.category_code, s.code_norm))
WHERE (s.name_norm IS NULL OR s.name_norm NOT IN (SELECT name_norm FROM syn_name))
  AND s.row_id NOT IN (SELECT row_id FROM text_score)
""")
cte("ranked", "text_score code_score sig boost", """
WITH c AS (SELECT *, 0.5::DOUBLE AS band FROM text_score UNION ALL SELECT *, 0.0 FROM code_score)
SELECT c.row_id, c.category_id, c.source, c.score,
  CASE WHEN b.boost IS NULL THEN c.score + c.band ELSE c.score + c.band + b.boost END AS rank_score,
  CASE WHEN b.boost IS NULL THEN c.score ELSE least(1.0, c.score + b.boost) END AS confidence
FROM c JOIN sig s USING (row_id)
LEFT JOIN boost b ON b.category_id = c.category_id AND b.name_norm IS NOT DISTINCT FROM s.name_norm AND b.code_norm IS NOT DISTINCT FROM s.code_norm
""")


def _closeness(t: str) -> str:
    return f"CASE WHEN {t} IS NULL THEN 0.0 WHEN c.cn = {t} THEN 1.0 WHEN {either('c.cn', t)} THEN 0.85 ELSE {jaccard(t, 'c.cn')} END"


cte("best", "ranked sig cat", f"""
WITH top AS (SELECT *, rank() OVER (PARTITION BY row_id ORDER BY rank_score DESC) AS r FROM ranked),
k AS (SELECT t.*, count(*) OVER (PARTITION BY t.row_id) AS tie_count, c.category_code AS cc, coalesce(s.code_norm = c.category_code, FALSE) AS same_code,
  greatest({_closeness('s.name_norm')}, {_closeness('s.mat_raw')}) AS near
  FROM top t JOIN sig s USING (row_id) JOIN cat c ON c.id = t.category_id WHERE t.r = 1)
SELECT row_id, category_id, source, rank_score, confidence, tie_count FROM k
QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY near DESC, same_code DESC, cc, category_id) = 1
""")
cte("settled", "best", """
SELECT row_id, category_id, rank_score, tie_count,
  CASE WHEN tie_count > 1 AND source IN ('NAME_FUZZY','EXTRA_NAME','SEMANTIC','MATERIAL_NAME') THEN 'FUZZY_AMBIGUOUS' ELSE source END AS source,
  CASE WHEN tie_count > 1 AND source IN ('NAME_FUZZY','EXTRA_NAME','SEMANTIC','MATERIAL_NAME') THEN least(confidence, 0.5) ELSE confidence END AS confidence
FROM best
""")
cte("outcome", "sig syn_name settled", """
SELECT s.row_id, coalesce(n.category_id, b.category_id) AS category_id,
  CASE WHEN n.category_id IS NOT NULL THEN 'SYNONYM' WHEN b.row_id IS NOT NULL THEN b.source ELSE 'UNMATCHED' END AS source,
  CASE WHEN n.category_id IS NOT NULL THEN 0.95 WHEN b.row_id IS NOT NULL THEN b.confidence ELSE 0.0 END::DOUBLE AS confidence
FROM sig s LEFT JOIN syn_name n ON n.name_norm = s.name_norm LEFT JOIN settled b ON b.row_id = s.row_id AND b.confidence >= 0.5
""")

# ---------------------------------------------------------------- library

cte("code_idx", "taxonomy", f"""
WITH c AS (SELECT {code('category_code')} AS code_norm, id, 0 AS slot FROM taxonomy UNION ALL SELECT {code('old_code_1')}, id, 1 FROM taxonomy)
SELECT code_norm, id AS category_id FROM c WHERE code_norm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code_norm ORDER BY id, slot) = 1
""")
cte("lib_text", "taxonomy synonyms", f"""
WITH t AS (SELECT id AS category_id, category_name AS text FROM taxonomy UNION ALL SELECT id, old_name_1 FROM taxonomy
  UNION ALL SELECT category_id, synonym_name FROM synonyms WHERE category_id IN (SELECT id FROM taxonomy))
SELECT DISTINCT category_id, {norm('text')} AS name_norm FROM t WHERE {norm('text')} IS NOT NULL
""")
cte("tok_idx", "lib_text", f"SELECT DISTINCT unnest({words('name_norm')}) AS token, category_id FROM lib_text")


def rule_sql(rows: str, matched: str = "category_id") -> str:
    """Rule check over ``rows`` (an aliased relation with the fields the check reads)."""
    n, m = norm("r.category_name"), norm("r.material_name")
    return f"""
SELECT f.*, CASE WHEN k_id IS NULL THEN 20.0 ELSE (CASE WHEN f_code THEN 35 ELSE 0 END + CASE WHEN f_name THEN 30 ELSE 0 END
    + CASE k_level WHEN 3 THEN 15 WHEN 2 THEN 8 ELSE 3 END + CASE WHEN f_unit THEN 10 ELSE 0 END + CASE WHEN f_desc THEN 10 ELSE 0 END)::DOUBLE END AS score,
  CASE WHEN k_id IS NULL THEN FALSE ELSE f_code AND f_name END AS consistent,
  CASE WHEN k_id IS NULL THEN '系统分类未命中标准库（无对应标准分类）' ELSE '编码'||CASE WHEN f_code THEN '一致' ELSE '不一致' END||'，名称'||CASE WHEN f_name THEN '一致' ELSE '不一致' END
    ||'，层级'||k_level||'，单位'||CASE WHEN f_unit THEN '一致' ELSE '不一致/空' END||'，描述关键词'||CASE WHEN f_desc THEN '命中' ELSE '未命中' END END AS reason
FROM (SELECT r.*, k.id AS k_id, k.level AS k_level, k.category_code AS best_code, k.category_name AS best_name,
   ({code('r.category_code')} IN (SELECT code_norm FROM code_idx)) IS TRUE AS f_code,
   ({n} = k.cn OR ({either(n, 'k.cn')} AND least(length({n}), length(k.cn)) >= 2)) IS TRUE OR ({n} = {norm('k.old_name_1')}) IS TRUE
     OR ({m} = k.cn OR ({either(m, 'k.cn')} AND least(length({m}), length(k.cn)) >= 2)) IS TRUE
     OR (len(list_intersect({words(m)}, {words('k.cn')})) > 0) IS TRUE AS f_name,
   {blank('r.unit')} OR {blank('k.unit')} OR lower({trim('r.unit')}) = lower({trim('k.unit')}) AS f_unit,
   (len(list_filter(list_concat({words(m)}, {words(norm('r.specification'))}, {words(norm('r.grade'))}), lambda w: contains({norm('k.description')}, w))) > 0) IS TRUE AS f_desc
  FROM {rows} r LEFT JOIN cat k ON k.id = r.{matched}) f"""


# ---------------------------------------------------------------- cleaned rows

cte("filled", "raw_rows attr outcome cat", """
SELECT r.title_id, r.row_id, r.row_index, o.category_id, c.category_code, c.level AS category_level, c.full_path AS category_full_path, c.category_name,
  o.source AS match_source, o.confidence AS match_confidence, r.col3 AS material_code, coalesce(a_name, a_short, '') AS material_name,
  coalesce(a_spec, '') AS specification, coalesce(a_std, '') AS technical_standard, coalesce(a_grade, '') AS grade, coalesce(a_unit, r.col6) AS unit,
  r.col5 AS full_description, md5(coalesce(c.category_code, '')||'||||'||coalesce(r.col5, '')) AS source_row_hash
FROM raw_rows r JOIN attr USING (row_id) JOIN outcome o USING (row_id) LEFT JOIN cat c ON c.id = o.category_id
""")
_filled = ["material_code", "material_name", "specification", "technical_standard", "grade", "unit"]
cte("scored", "filled cat code_idx", f"""
SELECT * EXCLUDE (k_id, k_level, best_code, best_name, f_code, f_name, f_unit, f_desc, score, consistent, reason),
  CASE WHEN row_number() OVER (PARTITION BY title_id, source_row_hash ORDER BY row_index, row_id) > 1 THEN 1 ELSE 0 END AS is_duplicate,
  ({' + '.join(f"CASE WHEN {blank(c)} THEN 0 ELSE 1 END" for c in _filled)}) / 6.0::DOUBLE * 100 AS completeness_score,
  score AS quality_score, score * 0.8::DOUBLE AS accuracy_score
FROM ({rule_sql('filled')})
""")
cte("cleaned", "scored", """
SELECT *, CASE WHEN category_id IS NULL OR match_source IN ('FUZZY_AMBIGUOUS','UNMATCHED') THEN 'needs_review' WHEN quality_score < 60 THEN 'needs_review'
  WHEN quality_score >= 80 THEN 'export_ready' ELSE 'approved' END AS status FROM scored
""")

cte("cleaned_log", "cleaned", """
SELECT *, row_id AS id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(row_id AS INTEGER)) AS created_at,
  CASE WHEN status <> 'needs_review' AND is_duplicate = 0 THEN TIMESTAMP '2024-01-02 00:00:00' + to_minutes(CAST(row_id AS INTEGER)) END AS reviewed_at,
  CASE WHEN status = 'export_ready' AND specification <> '' THEN TIMESTAMP '2024-01-03 00:00:00' + to_minutes(CAST(row_id AS INTEGER)) END AS exported_at,
  CASE WHEN status = 'export_ready' AND specification <> '' THEN title_id + 100 END AS export_batch_id
FROM cleaned
""")
cte("export_batches", "orders", """
SELECT o_orderkey AS batch_id, 'batch '||o_orderkey AS batch_name, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'failed' END AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'excel' WHEN '2' THEN 'csv' WHEN '3' THEN 'json' ELSE 'pdf' END AS format,
  CASE WHEN o_custkey % 2 = 0 THEN 'category' ELSE 'status' END AS batch_type, 'user'||(o_custkey % 20) AS created_by,
  CAST(o_totalprice AS BIGINT) AS total_records, CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS BIGINT) ELSE 0 END AS exported_records,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice * 50 AS BIGINT) END AS file_size, o_orderdate AS created_at, o_custkey % 5 + 100 AS run_id
FROM orders
""")
