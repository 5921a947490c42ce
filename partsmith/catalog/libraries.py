"""Queries over indexes, recall, keyword search, rule check and corrections."""

from __future__ import annotations

import re

from dataclasses import replace

from pyspark.sql import Window, functions as F

from partsmith.catalog.base import query
from partsmith.catalog.cleaned import cleaned
from partsmith.catalog.views import TABLES, VIEWS
from partsmith.catalog.oracle import CTES, blank, code, cte, norm, rule_sql, words
from partsmith.functions import text as T
from partsmith.operators import checks as C, library as L


def indexes(t) -> L.Indexes:
    if "indexes" not in t._made:
        made = L.build_indexes(t["taxonomy"], t["synonyms"])
        t._made["indexes"] = L.Indexes(*[t.keep(f"idx_{n}", lambda n=n: getattr(made, n)) for n in ("code", "name", "token")])
    return t._made["indexes"]


@query("src_indexes", "SELECT 'code' AS kind, code_norm AS key, category_id FROM code_idx UNION ALL SELECT 'name', name_norm, category_id FROM lib_text UNION ALL SELECT 'token', token, category_id FROM tok_idx")
def _(t):
    idx = indexes(t)
    parts = (("code", idx.code, "code_norm"), ("name", idx.name, "name_norm"), ("token", idx.token, "token"))
    out = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), "category_id") for kind, df, key in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("lib_by_code", "SELECT s.row_id, c.category_id AS lib_id FROM sig s LEFT JOIN code_idx c USING (code_norm)")
def _(t):
    return L.by_code(t["raw_rows"].select("row_id", "col1"), "col1", indexes(t)).select("row_id", "lib_id")


def recall_sql(rows: str, fields: list[tuple[str, float]], codes: list[tuple[str, float]], k: int = 10) -> str:
    text = " UNION ALL ".join(f"SELECT row_id, {norm(c)} AS n, {w}::DOUBLE AS w FROM {rows}" for c, w in fields)
    by_code = "".join(f" UNION ALL SELECT r.row_id, i.category_id, {w}::DOUBLE FROM {rows} r JOIN code_idx i ON i.code_norm = {code('r.' + c)}" for c, w in codes)
    return f"""WITH x AS ({text}), d AS (SELECT row_id, n, max(w) AS w FROM x WHERE n IS NOT NULL GROUP BY row_id, n),
 k AS (SELECT DISTINCT row_id, w, unnest({words('n')}) AS token FROM d),
 h AS (SELECT d.row_id, l.category_id, d.w FROM d JOIN lib_text l ON l.name_norm = d.n
   UNION ALL SELECT k.row_id, i.category_id, k.w * 0.6::DOUBLE FROM k JOIN tok_idx i USING (token){by_code}),
 b AS (SELECT h.row_id, h.category_id, max(h.w) AS relevance FROM h GROUP BY ALL)
 SELECT b.row_id, b.category_id, t.category_code, b.relevance, CAST(row_number() OVER (PARTITION BY b.row_id ORDER BY b.relevance DESC, t.category_code, b.category_id) AS INTEGER) AS rank
 FROM b JOIN taxonomy t ON t.id = b.category_id QUALIFY row_number() OVER (PARTITION BY b.row_id ORDER BY b.relevance DESC, t.category_code, b.category_id) <= {k}"""


_TEXT = [("category_name", 0.9), ("full_description", 0.95), ("material_name", 0.85), ("specification", 0.6), ("grade", 0.5)]
_CODES = [("category_code", 1.0), ("material_code", 0.8)]
cte("recalled", "cleaned lib_text tok_idx code_idx taxonomy", recall_sql("cleaned", _TEXT, _CODES))
cte("recheck_in", "cleaned", "SELECT * EXCLUDE (category_name), CAST(NULL AS VARCHAR) AS category_name FROM cleaned")


def recalled(t):
    return t.keep("recalled", lambda: L.recall(cleaned(t), t["taxonomy"], indexes(t)))


@query("lib_recall", "SELECT row_id, category_id, category_code, relevance, rank FROM recalled")
def _(t):
    return recalled(t)


@query("win_topk_recall", "SELECT row_id, category_id, rank FROM recalled WHERE rank <= 3")
def _(t):
    return L.recall(cleaned(t), t["taxonomy"], indexes(t), k=3).select("row_id", "category_id", "rank")


@query("join_recall", recall_sql("cleaned", [("material_name", 0.85)], [("category_code", 1.0)], 5))
def _(t):
    return L.recall(cleaned(t), t["taxonomy"], indexes(t), 5, {"category_code": 1.0}, {"material_name": 0.85})


_kw = f"""WITH q AS (SELECT row_id AS question_id, col2 AS raw FROM raw_rows WHERE NOT {blank('col2')}),
 h AS (SELECT question_id, category_id, 1 AS pass, 0 AS place FROM q JOIN code_idx i ON i.code_norm = {code('raw')}
  UNION ALL SELECT question_id, t.id, 2, 0 FROM q JOIN taxonomy t ON starts_with(t.category_code, trim(raw))
  UNION ALL SELECT question_id, l.category_id, 3, 0 FROM q JOIN lib_text l ON l.name_norm = {norm('raw')}
  UNION ALL SELECT question_id, i.category_id, 4, place FROM (SELECT question_id, unnest({words(norm('raw'))}) AS token, generate_subscripts({words(norm('raw'))}, 1) - 1 AS place FROM q) z JOIN tok_idx i USING (token)),
 b AS (SELECT question_id, category_id, min(pass * 1000 + place) AS o FROM h GROUP BY ALL),
 r AS (SELECT question_id, category_id, o, CAST(row_number() OVER (PARTITION BY question_id ORDER BY o, category_id) AS INTEGER) AS pos FROM b)"""


def keywords(t):
    return t["raw_rows"].select(F.col("row_id").alias("question_id"), F.col("col2").alias("keyword"))


@query("lib_search", _kw + " SELECT question_id, category_id, pos FROM r WHERE pos <= 15")
def _(t):
    return L.search(keywords(t), t["taxonomy"], indexes(t), 15)


@query("set_keyword_union", _kw + " SELECT question_id, category_id, CAST(o // 1000 AS INTEGER) AS pass, CAST(o % 1000 AS INTEGER) AS place FROM r")
def _(t):
    return L.keyword_union(keywords(t), t["taxonomy"], indexes(t), 1000000)


def recheck_input(t):
    """On a re-check the stored rows carry no category name."""
    return cleaned(t).withColumn("category_name", F.lit(None).cast("string"))


cte("src_named", "cleaned raw_rows", "SELECT c.* REPLACE (r.col2 AS category_name) FROM cleaned c JOIN raw_rows r USING (row_id)")
cte("rechecked", "recheck_in cat code_idx", rule_sql("recheck_in"))


@query("lib_rule_check", "SELECT row_id, score, consistent, best_code, best_name, reason FROM rechecked")
def _(t):
    return L.rule_check(recheck_input(t), t["taxonomy"], indexes(t)).select(
        "row_id", "score", "consistent", "best_code", "best_name", "reason")


@query("lib_rule_check_source", "SELECT row_id, score, consistent, reason FROM (" + rule_sql("src_named") + ")")
def _(t):
    named = cleaned(t).drop("category_name").join(
        t["raw_rows"].select("row_id", F.col("col2").alias("category_name")), "row_id")
    return L.rule_check(named, t["taxonomy"], indexes(t)).select("row_id", "score", "consistent", "reason")


@query("lib_name_match", "SELECT row_id, f_name AS ok FROM rechecked WHERE k_id IS NOT NULL")
def _(t):
    cat = t["taxonomy"].select(F.col("id").alias("category_id"), F.col("category_name").alias("std_name"), "old_name_1")
    return recheck_input(t).join(cat, "category_id").select(
        "row_id", L.name_agrees(F.col("category_name"), F.col("material_name"), F.col("std_name"), [F.col("old_name_1")]).alias("ok"))


@query("lib_unit_ok", "SELECT row_id, f_unit AS ok FROM rechecked WHERE k_id IS NOT NULL")
def _(t):
    cat = t["taxonomy"].select(F.col("id").alias("category_id"), F.col("unit").alias("std_unit"))
    return cleaned(t).join(cat, "category_id").select("row_id", T.same_unit(F.col("unit"), F.col("std_unit")).alias("ok"))


@query("lib_desc_hit", "SELECT row_id, f_desc AS ok FROM rechecked WHERE k_id IS NOT NULL")
def _(t):
    cat = t["taxonomy"].select(F.col("id").alias("category_id"), "description")
    return cleaned(t).join(cat, "category_id").select("row_id", L.description_hit(
        F.col("description"), F.col("material_name"), F.col("specification"), F.col("grade")).alias("ok"))


cte("recalled_check", "recheck_in lib_text tok_idx code_idx taxonomy", recall_sql("recheck_in", _TEXT, _CODES))
cte("detected", "rechecked recalled_check", """
SELECT r.row_id, r.title_id, r.match_source, r.category_id, r.score, r.consistent, CASE WHEN r.consistent OR r.best_code = r.category_code THEN NULL ELSE r.best_code END AS suggested_code, r.reason,
 coalesce(k.n, 0) AS candidate_count FROM rechecked r LEFT JOIN (SELECT row_id, count(*) AS n FROM recalled_check GROUP BY row_id) k USING (row_id)
""")


def detected(t):
    return t.keep("detected", lambda: C.detect(recheck_input(t), t["taxonomy"], indexes(t)))


@query("ck_detect", "SELECT row_id, score, consistent, suggested_code, reason, candidate_count FROM detected")
def _(t):
    return detected(t).select("row_id", "score", "consistent", "suggested_code", "reason", "candidate_count")


_thr = """WITH q AS (SELECT title_id, greatest(40.0, least(75.0, quantile_cont(score, 0.3))) AS r0, greatest(65.0, least(95.0, quantile_cont(score, 0.7))) AS e0 FROM detected GROUP BY title_id),
 b AS (SELECT title_id, r0::DOUBLE AS review, CASE WHEN e0 <= r0 THEN least(95.0, r0 + 5) ELSE e0 END::DOUBLE AS export FROM q)"""


@query("ck_check_file", _thr + """ SELECT d.row_id, d.score AS quality_score, CASE WHEN d.score < review THEN 'needs_review' WHEN d.score >= export THEN 'export_ready' ELSE 'approved' END AS status
 FROM detected d JOIN b USING (title_id)""")
def _(t):
    return C.check_file(detected(t), adaptive=True).select("row_id", F.col("score").alias("quality_score"), "status")


@query("agg_check_summary", _thr + """ SELECT d.title_id, count(*) AS total, floor(sum(score) / count(*) * 10 + 0.5) / 10 AS avg_score, count(*) FILTER (consistent) AS matched_count, count(*) FILTER (NOT consistent) AS mismatch_count,
 max(review) AS review, max(export) AS export FROM detected d JOIN b USING (title_id) GROUP BY d.title_id""")
def _(t):
    from partsmith.operators.reports import check_summary

    return check_summary(C.check_file(detected(t), adaptive=True))


cte("free_text", "raw_rows", f"SELECT row_id, col2 AS full_description, col2 AS material_name, col2 AS specification FROM raw_rows WHERE NOT {blank('col2')}")
cte("free_hits", "free_text lib_text tok_idx code_idx taxonomy",
    recall_sql("free_text", [("full_description", 0.95), ("material_name", 0.85), ("specification", 0.6)], []))


@query("ck_classify_text", """SELECT r.row_id AS text_id, h.category_code AS code, t.category_name AS name, h.relevance, coalesce(n.n, 0) AS n_candidates
 FROM raw_rows r LEFT JOIN free_hits h ON h.row_id = r.row_id AND h.rank = 1 LEFT JOIN taxonomy t ON t.id = h.category_id LEFT JOIN (SELECT row_id, count(*) AS n FROM free_hits GROUP BY row_id) n ON n.row_id = r.row_id""")
def _(t):
    texts = t["raw_rows"].select(F.col("row_id").alias("text_id"), F.col("col2").alias("text"))
    return C.classify_text(texts, t["taxonomy"], indexes(t)).select("text_id", "code", "name", "relevance", "n_candidates")


# Long texts; every third holds nothing but the name of a category, every sixth its code's name in brackets.
cte("free_docs", "documents taxonomy", f"""WITH k AS (SELECT category_name, row_number() OVER (ORDER BY id) - 1 AS rn FROM taxonomy)
 SELECT doc_id AS row_id, CASE WHEN doc_id % 6 = 0 THEN '['||upper(category_name)||']' WHEN doc_id % 3 = 0 THEN category_name ELSE text END AS full_description,
 full_description AS material_name, full_description AS specification FROM documents JOIN k ON k.rn = doc_id % 200 WHERE NOT {blank('text')}""")
cte("doc_hits", "free_docs lib_text tok_idx code_idx taxonomy",
    recall_sql("free_docs", [("full_description", 0.95), ("material_name", 0.85), ("specification", 0.6)], []))


@query("ck_classify_documents", """SELECT r.row_id AS text_id, h.category_code AS code, t.category_name AS name, h.relevance, coalesce(n.n, 0) AS n_candidates
 FROM free_docs r LEFT JOIN doc_hits h ON h.row_id = r.row_id AND h.rank = 1 LEFT JOIN taxonomy t ON t.id = h.category_id LEFT JOIN (SELECT row_id, count(*) AS n FROM doc_hits GROUP BY row_id) n ON n.row_id = r.row_id""")
def _(t):
    names = t["taxonomy"].select("category_name", (F.row_number().over(Window.orderBy("id")) - 1).alias("rn"))
    texts = t["documents"].join(names, F.col("doc_id") % 200 == F.col("rn")).select(
        F.col("doc_id").alias("text_id"),
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("["), F.upper("category_name"), F.lit("]")))
        .when(F.col("doc_id") % 3 == 0, F.col("category_name")).otherwise(F.col("text")).alias("text"))
    return C.classify_text(texts, t["taxonomy"], indexes(t)).select("text_id", "code", "name", "relevance", "n_candidates")


# ---------------------------------------------------------------- corrections

def corrections(t):
    """Ambiguous rows get the category the parser's material name recalls first; some requests are unusable."""
    amb = cleaned(t).where("match_source = 'FUZZY_AMBIGUOUS'").select("row_id")
    best = recalled(t).where("rank = 1").select("row_id", F.col("category_code").alias("target_code"))
    lost = cleaned(t).where("match_source = 'UNMATCHED'").select("row_id", F.lit("NO-SUCH").alias("target_code"))
    none = cleaned(t).where("match_source = 'CODE_EXACT'").select("row_id", F.lit(None).cast("string").alias("target_code"))
    return best.join(amb, "row_id", "left_semi").unionByName(lost).unionByName(none)


cte("correction", "cleaned recalled", """
SELECT row_id, category_code AS target_code FROM recalled WHERE rank = 1 AND row_id IN (SELECT row_id FROM cleaned WHERE match_source = 'FUZZY_AMBIGUOUS')
UNION ALL SELECT row_id, 'NO-SUCH' FROM cleaned WHERE match_source = 'UNMATCHED' UNION ALL SELECT row_id, NULL FROM cleaned WHERE match_source = 'CODE_EXACT'
""")
cte("fix_in", "cleaned correction code_idx cat raw_rows", f"""
SELECT c.* REPLACE (k.id AS category_id, k.category_code AS category_code, k.category_name AS category_name), c.category_code AS old_code, r.col2 AS old_name
FROM correction x JOIN cleaned c USING (row_id) JOIN raw_rows r USING (row_id) JOIN code_idx i ON i.code_norm = {code('x.target_code')} JOIN cat k ON k.id = i.category_id
""")
cte("fixed", "fix_in cat code_idx raw_rows", rule_sql("fix_in"))


def fix(t):
    if "fix" not in t._made:
        named = cleaned(t).join(t["raw_rows"].select("row_id", F.col("col2").alias("source_name")), "row_id")
        t._made["fix"] = C.apply_corrections(named, corrections(t), t["taxonomy"], indexes(t))
    return t._made["fix"]


@query("fx_apply", "SELECT row_id, category_code, score AS quality_score, CASE WHEN score < 60 THEN 'needs_review' WHEN score >= 80 THEN 'export_ready' ELSE 'approved' END AS status FROM fixed")
def _(t):
    return fix(t).fixed.select("row_id", "category_code", "quality_score", "status")


@query("fx_summary", f"""SELECT count(*) FILTER (target_code IS NOT NULL AND i.category_id IS NOT NULL) AS applied, count(*) FILTER (target_code IS NULL) AS skipped, count(*) FILTER (target_code IS NOT NULL AND i.category_id IS NULL) AS failed
 FROM correction x LEFT JOIN code_idx i ON i.code_norm = {code('x.target_code')}""")
def _(t):
    return fix(t).summary


@query("fx_synonyms", f"""SELECT DISTINCT f.category_id, trim(f.old_name) AS synonym_name FROM fixed f WHERE NOT {blank('f.old_name')} AND trim(f.old_name) <> f.category_name
 AND NOT EXISTS (SELECT 1 FROM synonyms s WHERE s.category_id = f.category_id AND s.synonym_name = trim(f.old_name))""")
def _(t):
    return C.feedback_synonyms(fix(t).fixed, t["synonyms"]).select("category_id", "synonym_name")


@query("fx_samples", "SELECT 'CORRECTION' AS sample_type, row_id AS entity_id, old_name AS source_category_name, old_code AS source_category_code, category_id AS target_category_id, category_code AS target_category_code, score FROM fixed")
def _(t):
    return C.correction_samples(fix(t).fixed).select(
        "sample_type", "entity_id", "source_category_name", "source_category_code", "target_category_id", "target_category_code", "score")


# ---------------------------------------------------------------- names whose words are shared

def _comma_names(*roots: str) -> dict[str, str]:
    """Copies of the SQL building blocks over a taxonomy whose names have commas, so that words stay apart and are shared."""
    cte("taxonomy_c", "taxonomy", "SELECT * REPLACE (replace(category_name, ' ', ',') AS category_name) FROM taxonomy")
    names = {"taxonomy": "taxonomy_c"}

    def visit(name: str) -> None:
        if name in names or name in TABLES or name in VIEWS:
            return
        deps, sql = CTES[name]
        for d in deps:
            visit(d)
        names[name] = f"{name}_c"
        for old in deps:
            sql = re.sub(rf"\b{old}\b", names.get(old, old), sql)
        cte(names[name], " ".join(names.get(d, d) for d in deps), sql)

    for r in roots:
        visit(r)
    return names


_names = _comma_names("lib_text", "tok_idx", "code_idx")
cte("rows_c", "raw_rows", "SELECT row_id, replace(col2, ' ', ',') AS material_name FROM raw_rows WHERE col2 IS NOT NULL")
_shared_recall = recall_sql("rows_c", [("material_name", 0.85)], [])
for _old, _new in _names.items():
    _shared_recall = re.sub(rf"\b{_old}\b", _new, _shared_recall)


@query("lib_recall_shared", _shared_recall)
def _(t):
    names = t["taxonomy"].withColumn("category_name", F.translate("category_name", " ", ","))
    rows = t["raw_rows"].where("col2 is not null").select("row_id", F.translate("col2", " ", ",").alias("material_name"))
    return L.recall(rows, names, L.build_indexes(names, t["synonyms"]))
