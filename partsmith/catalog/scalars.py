"""Queries over the scalar functions, each on whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.cleaned import cleaned
from partsmith.catalog.oracle import blank, code, either, field, grams, jaccard, norm, trim, words
from partsmith.functions import jsontext as J, questions as Qn, scores as S, text as T

NOW = "TIMESTAMP '1998-06-01 00:00:00'"


def now():
    return F.expr("TIMESTAMP_NTZ'1998-06-01 00:00:00'")


@query("fn_jtrim", f"SELECT doc_id, {trim('text')} AS trimmed, {blank('text')} AS blank FROM documents")
def _(t):
    return t["documents"].select("doc_id", T.jtrim(F.col("text")).alias("trimmed"), T.is_blank(F.col("text")).alias("blank"))


@query("fn_norm_name", f"SELECT row_id, {norm('col2')} AS n FROM raw_rows")
def _(t):
    return t["raw_rows"].select("row_id", T.norm_name(F.col("col2")).alias("n"))


@query("fn_norm_code", f"SELECT row_id, {code('col1')} AS n FROM raw_rows")
def _(t):
    return t["raw_rows"].select("row_id", T.norm_code(F.col("col1")).alias("n"))


@query("fn_norm_field", f"SELECT item_id, {field('text')} AS n FROM benchmark")
def _(t):
    return t["benchmark"].select("item_id", T.norm_field(F.col("text")).alias("n"))


@query("fn_tokenize", f"SELECT doc_id, len({words('text')}) AS n, array_to_string({words('text')}, ' ') AS tokens FROM documents")
def _(t):
    w = T.tokens(F.col("text"))
    return t["documents"].select("doc_id", F.size(w).cast("long").alias("n"), F.array_join(w, " ").alias("tokens"))


@query("fn_bigrams", f"SELECT id, array_to_string(list_sort({grams('category_name')}), '|') AS grams FROM taxonomy")
def _(t):
    return t["taxonomy"].select("id", F.array_join(F.sort_array(T.bigrams(F.col("category_name"))), "|").alias("grams"))


@query("fn_jaccard", f"SELECT c.row_id, {jaccard('c.material_name', 'c.category_name')} AS sim FROM cleaned c")
def _(t):
    return cleaned(t).select("row_id", T.jaccard(F.col("material_name"), F.col("category_name")).alias("sim"))


@query("set_bigram", f"""SELECT row_id, len(list_intersect({grams('material_name')}, {grams('category_name')})) AS n_inter, len(list_distinct(list_concat({grams('material_name')}, {grams('category_name')}))) AS n_union
 FROM cleaned WHERE category_name IS NOT NULL AND material_name <> ''""")
def _(t):
    a, b = T.bigrams(F.col("material_name")), T.bigrams(F.col("category_name"))
    return cleaned(t).where("category_name is not null and material_name <> ''").select(
        "row_id", F.size(F.array_intersect(a, b)).alias("n_inter"), F.size(F.array_union(a, b)).alias("n_union"))


@query("fn_contains_either", f"SELECT row_id, ({either('material_name', 'category_name')} AND least(length(material_name), length(category_name)) >= 2) IS TRUE AS ok FROM cleaned")
def _(t):
    return cleaned(t).select("row_id", T.contains_either(F.col("material_name"), F.col("category_name"), 2).alias("ok"))


@query("fn_row_hash", "SELECT row_id, md5(coalesce(category_code,'')||'|'||coalesce(material_code,'')||'|'||specification||'|'||grade||'|'||coalesce(full_description,'')) AS h FROM cleaned")
def _(t):
    return cleaned(t).select("row_id", S.row_hash(*[F.col(c) for c in (
        "category_code", "material_code", "specification", "grade", "full_description")]).alias("h"))


@query("fn_payload_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t["documents"].select("doc_id", S.payload_digest(F.col("text")).alias("digest"))


@query("fn_split_multi", f"""WITH p AS (SELECT conv_id, turn, {trim('x')} AS x, i FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[,，]')) AS x, generate_subscripts(regexp_split_to_array(text, '[,，]'), 1) AS i FROM conversations)),
 d AS (SELECT conv_id, turn, x, min(i) AS i FROM p WHERE x <> '' GROUP BY conv_id, turn, x)
 SELECT c.conv_id, c.turn, c.role, coalesce(string_agg(d.x, ',' ORDER BY d.i), '') AS parts FROM conversations c LEFT JOIN d ON d.conv_id = c.conv_id AND d.turn = c.turn GROUP BY c.conv_id, c.turn, c.role""")
def _(t):
    return t["conversations"].select("conv_id", "turn", "role", T.split_multi(F.col("text")).alias("parts"))


@query("fn_template", "SELECT row_id, left('物料 '||material_name||' 规格 '||specification||' 编码 '||coalesce(category_code, '')||' '||coalesce(full_description, ''), 200) AS text FROM cleaned")
def _(t):
    slots = {n: F.col(n) for n in ("material_name", "specification", "category_code", "full_description")}
    filled = T.fill_template("物料 {material_name} 规格 {specification} 编码 {category_code} {full_description}", slots)
    return cleaned(t).select("row_id", T.cut(filled, 200).alias("text"))


@query("fn_json_extract", "SELECT ts, payload, json_extract_string(payload, '$.taskId') AS task_id, json_extract_string(payload, '$.status') AS status FROM callbacks")
def _(t):
    fenced = F.concat(F.lit("答复如下：\n"), F.lit("```json\n"), "payload", F.lit("\n```"))
    wrapped = F.when(F.contains("payload", F.lit("click")), F.concat(F.lit("```json\n"), "payload", F.lit("\n```"))).otherwise(
        F.when(F.contains("payload", F.lit("view")), fenced).otherwise(F.concat(F.lit("结果: "), "payload", F.lit(" 完"))))
    body = F.from_json(J.json_block(wrapped), "struct<taskId:string,status:string>")
    return t["callbacks"].select("ts", "payload", body["taskId"].alias("task_id"), body["status"].alias("status"))


@query("fn_json_fix_escape", r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(replace(text, 'n', '\'), '(?s)[^\\]+|\\["\\/bfnrtu]|\\'), lambda x: CASE WHEN x = '\' THEN '\\' ELSE x END), '') AS fixed FROM documents""")
def _(t):
    return t["documents"].select("doc_id", J.fix_escapes(F.replace("text", F.lit("n"), F.lit("\\"))).alias("fixed"))


@query("fn_json_flat_map", """SELECT event_id, 'k='||json_extract_string(props, '$.k') AS flat FROM events""")
def _(t):
    flat = F.array_join(F.transform(F.map_entries(J.flat_map(F.col("props"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return t["events"].select("event_id", flat.alias("flat"))


@query("fn_sheet_name", rf"SELECT page_id, left(left({trim(r"regexp_replace(url, '[\\/:*?\[\]]', '_', 'g')")}, 25)||'_'||page_id, 31) AS sheet FROM pages")
def _(t):
    return t["pages"].select("page_id", T.sheet_name(F.col("url"), F.col("page_id")).alias("sheet"))


@query("fn_completeness", "SELECT row_id, completeness_score AS pct FROM scored")
def _(t):
    from partsmith.operators.cleaning import CORE

    return cleaned(t).select("row_id", S.completeness(*[F.col(c) for c in CORE]).alias("pct"))


@query("fn_detect_levels", """SELECT conv_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(question, '(\\d{1,2})\\s*级', 1), regexp_extract_all(question, '层级\\s*(\\d{1,2})', 1),
 list_transform(regexp_extract_all(question, '([一二三四五六七八九])级', 1), lambda d: translate(d, '一二三四五六七八九', '123456789'))), lambda d: CAST(d AS INTEGER)))), ',') AS levels FROM questions""".replace("\\\\", "\\"))
def _(t):
    return t["questions"].select("conv_id", F.array_join(F.transform(Qn.levels_in(F.col("question")), lambda x: x.cast("string")), ",").alias("levels"))


@query("fn_extract_codes", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{2,6}'))), ',') AS codes FROM documents")
def _(t):
    return t["documents"].select("doc_id", F.array_join(F.sort_array(Qn.codes_in(F.col("text"))), ",").alias("codes"))


@query("fn_similar_query", f"""SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN trim(replace(question, '查', '查')) WHEN conv_id % 4 = 1 THEN '一级分类' WHEN conv_id % 4 = 2 THEN regexp_extract(question, '和 (.+) 相似', 1) ELSE {trim('question')} END AS target FROM questions""")
def _(t):
    return t["questions"].select("conv_id", Qn.similar_target(F.col("question")).alias("target"))


@query("fn_status_text", """SELECT task_id, CASE status WHEN 'pending' THEN '待处理' WHEN 'assigned' THEN '已分配' WHEN 'in_progress' THEN '处理中' WHEN 'completed' THEN '已完成' WHEN 'cancelled' THEN '已取消' ELSE status END AS label,
 CASE priority WHEN 'urgent' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END AS weight, CASE status WHEN 'completed' THEN 100 WHEN 'in_progress' THEN 50 WHEN 'assigned' THEN 25 ELSE 0 END AS progress FROM review_tasks""")
def _(t):
    return t["review_tasks"].select(
        "task_id", S.status_text(F.col("status")).alias("label"), S.priority_weight(F.col("priority")).alias("weight"),
        S.progress_of(F.col("status")).alias("progress"))


@query("fn_dates", f"""SELECT task_id, CAST(trunc(epoch(due_at - {NOW}) / 3600) AS BIGINT) AS hours_left, CASE WHEN completed_at IS NULL AND due_at < {NOW} THEN CAST(trunc(epoch({NOW} - due_at) / 86400) AS BIGINT) ELSE 0 END AS overdue_days,
 CAST(trunc(epoch(completed_at - assigned_at) / 60) AS BIGINT) AS minutes FROM review_tasks""")
def _(t):
    return t["review_tasks"].select(
        "task_id", S.hours_left(F.col("due_at"), now()).alias("hours_left"),
        S.overdue_days(F.col("due_at"), now(), F.col("completed_at")).alias("overdue_days"),
        S.minutes_between(F.col("assigned_at"), F.col("completed_at")).alias("minutes"))


@query("set_field_diff", f"""SELECT row_id, array_to_string(list_sort(list_filter(list_distinct({words('col2')}), lambda w: NOT list_contains({words('col5')}, w))), ',') AS missing FROM raw_rows""")
def _(t):
    gone = F.array_except(T.tokens(F.col("col2")), T.tokens(F.col("col5")))
    return t["raw_rows"].select("row_id", F.array_join(F.sort_array(gone), ",").alias("missing"))


@query("udf_similarity", f"""SELECT row_id, {jaccard('material_name', 'category_name')} AS gram_sim,
 CASE WHEN material_name = '' OR category_name IS NULL THEN 0.0 ELSE 1.0 - levenshtein(lower(material_name), lower(category_name))::DOUBLE / greatest(length(material_name), length(category_name)) END::DOUBLE AS edit_sim FROM cleaned""")
def _(t):
    a, b = F.col("material_name"), F.col("category_name")
    strategies: dict[str, T.Similarity] = {"gram_sim": T.jaccard, "edit_sim": T.edit_similarity}
    return cleaned(t).select("row_id", *[s(a, b).alias(n) for n, s in strategies.items()])


@query("udf_similarity_vectors", """WITH m AS (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY label)
 SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], m.ref::DOUBLE[]), 9) AS sim FROM embeddings e JOIN m USING (label)""")
def _(t):
    ref = t["embeddings"].groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return t["embeddings"].join(ref, "label").select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("ref")), 9).alias("sim"))


@query("src_cell_text", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS quantity,
 CAST(l_quantity > 25 AS VARCHAR) AS big FROM lineitem""")
def _(t):
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", T.cell_text(F.col("l_quantity")).alias("quantity"), T.cell_text(F.col("l_quantity") > 25).alias("big"))
