"""Queries over question answering and similar rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.cleaned import cleaned
from partsmith.catalog.libraries import indexes
from partsmith.catalog.oracle import blank, code, cte, norm, trim, words
from partsmith.operators import retrieval as R

cte("ask", "questions", rf"SELECT conv_id, question, {trim("regexp_replace(question, '[0-9]{2,6}', ' ', 'g')")} AS kw, regexp_extract_all(question, '[0-9]{{2,6}}') AS codes FROM questions")
cte("ask_hit", "ask code_idx down taxonomy lib_text tok_idx", rf"""
WITH c AS (SELECT conv_id, unnest(codes) AS code FROM ask), x AS (SELECT c.conv_id, c.code, i.category_id AS hit FROM c LEFT JOIN code_idx i ON i.code_norm = c.code),
lv AS (SELECT conv_id, unnest(list_transform(list_concat(regexp_extract_all(question, '(\d{{1,2}})\s*级', 1), regexp_extract_all(question, '层级\s*(\d{{1,2}})', 1),
  list_transform(regexp_extract_all(question, '([一二三四五六七八九])级', 1), lambda d: translate(d, '一二三四五六七八九', '123456789'))), lambda d: CAST(d AS INTEGER))) AS level FROM ask),
k AS (SELECT conv_id, category_id, 1 AS pass, 0 AS place FROM ask JOIN code_idx i ON i.code_norm = {code('kw')}
  UNION ALL SELECT conv_id, t.id, 2, 0 FROM ask JOIN taxonomy t ON kw <> '' AND starts_with(t.category_code, kw)
  UNION ALL SELECT conv_id, l.category_id, 3, 0 FROM ask JOIN lib_text l ON l.name_norm = {norm('kw')}
  UNION ALL SELECT conv_id, i.category_id, 4, place FROM (SELECT conv_id, unnest({words(norm('kw'))}) AS token, generate_subscripts({words(norm('kw'))}, 1) AS place FROM ask) z JOIN tok_idx i USING (token)),
kb AS (SELECT conv_id, category_id, min(pass * 100000 + place) AS o FROM k GROUP BY conv_id, category_id QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min(pass * 100000 + place), category_id) <= 15),
f AS (SELECT x.conv_id, d.id AS category_id FROM x JOIN down d ON d.root_id = x.hit UNION SELECT x.conv_id, d.root_id FROM x JOIN down d ON d.id = x.hit
  UNION SELECT x.conv_id, t.id FROM x JOIN taxonomy t ON x.hit IS NULL AND starts_with(t.category_code, x.code) UNION SELECT lv.conv_id, t.id FROM lv JOIN taxonomy t USING (level) UNION SELECT conv_id, category_id FROM kb),
o AS (SELECT *, contains(question, '有哪些') OR contains(question, '列出') OR contains(question, '列举') AS listing FROM ask WHERE conv_id NOT IN (SELECT conv_id FROM f)),
w AS (SELECT conv_id, unnest({words('kw')}) AS token, generate_subscripts({words('kw')}, 1) AS place FROM o WHERE NOT listing),
z AS (SELECT w.conv_id, t.id AS category_id, min(place) AS place FROM w JOIN taxonomy t ON length(token) >= 2 AND (contains(t.category_name, token) OR contains(t.category_code, token)) GROUP BY w.conv_id, t.id
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY min(place), t.id) <= 40)
SELECT conv_id, category_id FROM f UNION ALL SELECT o.conv_id, t.id FROM o JOIN taxonomy t ON o.listing AND t.level = 1 UNION ALL SELECT conv_id, category_id FROM z
""")
cte("ask_context", "ask_hit taxonomy", """
SELECT h.conv_id, h.category_id, CAST(row_number() OVER (PARTITION BY h.conv_id ORDER BY t.level, t.category_code, t.id) AS INTEGER) AS pos
FROM ask_hit h JOIN taxonomy t ON t.id = h.category_id QUALIFY row_number() OVER (PARTITION BY h.conv_id ORDER BY t.level, t.category_code, t.id) <= 40
""")


@query("rt_last_question", "SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' AND text <> '' GROUP BY conv_id")
def _(t):
    return R.last_question(t["conversations"])


@query("rt_context", "SELECT conv_id, category_id, pos FROM ask_context")
def _(t):
    return R.context(t["questions"], t["taxonomy"], indexes(t))


_line = "'[编码 '||category_code||'] '||category_name||'（层级'||level||'） | 路径:'||full_path||coalesce(' | 单位:'||unit, '')||coalesce(' | 说明:'||description, '')"


@query("rt_format", f"SELECT conv_id, string_agg({_line}, chr(10) ORDER BY pos) AS text FROM ask_context a JOIN taxonomy t ON t.id = a.category_id GROUP BY conv_id")
def _(t):
    return R.format_context(R.context(t["questions"], t["taxonomy"], indexes(t)), t["taxonomy"])


_target = "CASE WHEN conv_id % 4 = 1 THEN '一级分类' WHEN conv_id % 4 = 2 THEN regexp_extract(question, '和 (.+) 相似', 1) ELSE question END"
_hay = "material_name||' '||specification||' '||coalesce(full_description, '')||' '||grade"


@query("rt_similar", f"""WITH q AS (SELECT conv_id, {words(_target)}[1:6] AS w FROM questions), a AS (SELECT DISTINCT conv_id, unnest(w) AS token FROM q),
 h AS (SELECT DISTINCT a.conv_id, c.row_id FROM a JOIN cleaned c ON contains(material_name, token) OR contains(specification, token) OR contains(full_description, token) OR contains(grade, token)),
 n AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY row_id DESC) <= 200),
 s AS (SELECT n.conv_id, n.row_id, list_filter(list_distinct(q.w), lambda x: list_contains({words(_hay)}, x)) AS hit, len(list_distinct(q.w)) AS n FROM n JOIN q USING (conv_id) JOIN cleaned c USING (row_id)),
 r AS (SELECT conv_id, row_id, len(hit) AS k, floor(len(hit)::DOUBLE / n * 100 + 0.5) / 100 AS score FROM s WHERE len(hit) > 0)
 SELECT conv_id, row_id, score, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, row_id DESC) AS INTEGER) AS place FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, row_id DESC) <= 10""")
def _(t):
    return R.similar(t["questions"], cleaned(t)).drop("matched")
