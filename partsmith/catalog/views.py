"""Input views over the given tables, as SQL that Spark and DuckDB both run.

The given tables hold no material master, so these views derive one: a
three-level taxonomy, messy spreadsheet rows, synonyms, standard headers,
review tasks and events, callbacks, questions and model responses.  They are
inputs only; every operator under test is written separately for each engine.
``VIEWS[name] = (names it reads, SQL with {placeholders})``.
"""

from __future__ import annotations

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

# Ranks run over the distinct words of the part names, a vocabulary, not over parts.
VIEWS["taxonomy"] = (("part",), """
WITH leaf AS (SELECT DISTINCT split_part(p_name,' ',1) AS adj, split_part(p_name,' ',2) AS noun, lower(p_type) AS typ FROM {part}),
n AS (SELECT noun, 9 + dense_rank() OVER (ORDER BY noun) AS k FROM (SELECT DISTINCT noun FROM leaf) x),
t AS (SELECT typ, dense_rank() OVER (ORDER BY typ) AS k FROM (SELECT DISTINCT typ FROM leaf) x),
a AS (SELECT adj, dense_rank() OVER (ORDER BY adj) AS k FROM (SELECT DISTINCT adj FROM leaf) x),
l3 AS (SELECT n.k AS c1, n.k*100+t.k AS c2, (n.k*100+t.k)*100+a.k AS c3, leaf.noun, leaf.typ, leaf.adj, a.k AS ak, t.k AS tk
       FROM leaf JOIN n ON leaf.noun=n.noun JOIN t ON leaf.typ=t.typ JOIN a ON leaf.adj=a.adj)
SELECT CAST(c3 AS BIGINT) AS id, CAST(c3 AS STRING) AS category_code, adj||' '||noun||' '||typ AS category_name, CAST(c2 AS BIGINT) AS parent_id, 3 AS level,
       '/'||CAST(c1 AS STRING)||'/'||CAST(c2 AS STRING)||'/'||CAST(c3 AS STRING) AS full_path,
       CASE WHEN c3 % 3 = 0 THEN NULL WHEN c3 % 3 = 1 THEN 'pcs' ELSE 'KG' END AS unit,
       CASE WHEN c3 % 4 = 0 THEN NULL ELSE 'all '||adj||' '||noun||' parts' END AS description,
       CAST(ak AS INT) AS sort_order, 'X'||CAST(c3 AS STRING) AS old_code_1, noun||'_old_'||adj||'_'||typ AS old_name_1 FROM l3
UNION ALL
SELECT DISTINCT CAST(c2 AS BIGINT), CAST(c2 AS STRING), noun||' '||typ, CAST(c1 AS BIGINT), 2, '/'||CAST(c1 AS STRING)||'/'||CAST(c2 AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(tk AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM l3
UNION ALL
SELECT DISTINCT CAST(c1 AS BIGINT), CAST(c1 AS STRING), noun, CAST(NULL AS BIGINT), 1, '/'||CAST(c1 AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(c1 AS INT), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM l3
""")

_MESSY = """
 CASE k % 6 WHEN 0 THEN code WHEN 1 THEN substr(code,1,4) WHEN 2 THEN NULL WHEN 3 THEN '109999' WHEN 4 THEN substr(code,1,2)||'-'||substr(code,3,4) ELSE 'ZZ999' END AS col1,
 CASE k % 8 WHEN 0 THEN cname WHEN 1 THEN '['||upper(cname)||']' WHEN 2 THEN noun WHEN 3 THEN substr(cname,1,length(cname)-1)||'x' WHEN 4 THEN 'alias '||noun||' '||typ WHEN 5 THEN oname WHEN 6 THEN p_name ELSE 'misc item' END AS col2,
 CASE WHEN k % 11 = 0 THEN '' ELSE 'M'||lpad(CAST(k AS STRING),8,'0') END AS col3, p_brand AS col4,
 CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN '物资名称 '||p_name||';规格 '||CAST(p_size AS STRING)||';规格 '||CAST(p_size+1 AS STRING) WHEN 2 THEN ' 物资简称 '||p_name||' ;;noseparator;牌号 '||p_brand||';;'
   ELSE '物资名称 '||p_name||';规格 '||CAST(p_size AS STRING)||';牌号 '||p_brand||';技术标准号 GB-'||CAST(p_size AS STRING)||';计量单位 pcs' END AS col5, 'pcs' AS col6
"""

_PARTS = """SELECT p.p_partkey AS k, p.p_name, p.p_brand, p.p_size, split_part(p.p_name,' ',2) AS noun, lower(p.p_type) AS typ, t.category_code AS code, t.category_name AS cname, t.old_name_1 AS oname
  FROM {part} p JOIN {taxonomy} t ON t.category_name = p.p_name||' '||lower(p.p_type) AND t.level = 3"""

# Parts of the two smallest sizes appear twice: exact copies for the duplicate flag.
VIEWS["raw_rows"] = (("part", "taxonomy"), f"""
WITH p AS ({_PARTS}),
r AS (SELECT p.*, 0 AS copy FROM p UNION ALL SELECT p.*, 1 AS copy FROM p WHERE p_size <= 2)
SELECT 1 + k % 3 AS title_id, k*2+copy AS row_id, CAST(2 + k*2+copy AS BIGINT) AS row_index, {_MESSY}
FROM r
""")

# The benchmark's rows, one per lineitem.  Order and line number repeat in the
# given table, so the row id hashes the whole line; DuckDB never reads this view.
VIEWS["raw_rows_big"] = (("part", "taxonomy", "lineitem"), f"""
WITH p AS ({_PARTS}),
r AS (SELECT l.l_suppkey % 16 AS title_id, xxhash64(l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice, l.l_shipdate) AS row_id, CAST(2 + l.l_orderkey*10 + l.l_linenumber AS BIGINT) AS row_index, p.*
      FROM {{lineitem}} l JOIN p ON l.l_partkey = p.k)
SELECT title_id, row_id, row_index, {_MESSY} FROM r
""")

_HEADER = ["分类编码", "类别名称", "物料代码", "品牌", "全描述", "计量单位"]
_HEADER_ROWS = " UNION ALL ".join(f"SELECT {i} AS pos, '{n}' AS name" for i, n in enumerate(_HEADER, 1))

VIEWS["raw_title"] = (("raw_rows",), """
SELECT title_id, 'file_'||CAST(title_id AS STRING)||'.csv' AS file_name, CAST(count(*) AS BIGINT) AS total_rows,
  CASE WHEN title_id = 2 THEN 'processing' ELSE 'completed' END AS status,
  CASE title_id WHEN 1 THEN TIMESTAMP '2024-01-02 00:00:00' WHEN 2 THEN TIMESTAMP '2024-01-03 00:00:00' ELSE TIMESTAMP '2024-01-04 00:00:00' END AS created_at
FROM {raw_rows} GROUP BY title_id
""")
VIEWS["raw_header"] = (("raw_title",), f"SELECT t.title_id, h.pos, h.name FROM {{raw_title}} t JOIN ({_HEADER_ROWS}) h ON h.pos > 0")
VIEWS["raw_header_big"] = (("lineitem",), f"""
SELECT t.title_id, h.pos, h.name FROM (SELECT DISTINCT l_suppkey % 16 AS title_id FROM {{lineitem}}) t JOIN ({_HEADER_ROWS}) h ON h.pos > 0""")

VIEWS["synonyms"] = (("taxonomy",), """
SELECT id*10+1 AS id, id AS category_id, 'alias '||category_name AS synonym_name, CASE WHEN id % 2 = 0 THEN NULL ELSE lower(replace('alias '||category_name,' ','')) END AS synonym_norm
FROM {taxonomy} WHERE level IN (2,3) AND category_name NOT LIKE '%promo'
""")

# Level-3 categories of one product type have no standard header.
_TARGETS = ["物资名称", "规格", "牌号", "技术标准号", "计量单位", "物料代码"]
_TARGET_ROWS = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{n}' AS target, {'TRUE' if i <= 2 else 'FALSE'} AS is_must" for i, n in enumerate(_TARGETS, 1))
VIEWS["std_header"] = (("taxonomy",), f"""
SELECT t.id + 5000000 AS std_id, t.category_code, CAST(h.pos AS INT) AS pos, h.target, h.is_must
FROM {{taxonomy}} t JOIN ({_TARGET_ROWS}) h ON h.pos > 0
WHERE t.level = 3 AND t.category_name NOT LIKE '%economy'
""")
VIEWS["field_rules"] = (("taxonomy",), """
SELECT t.category_code, h.target, h.is_required, CAST(h.min_length AS INT) AS min_length, CAST(h.max_length AS INT) AS max_length, h.pattern
FROM {taxonomy} t JOIN (
  SELECT '规格' AS target, TRUE AS is_required, 1 AS min_length, 4 AS max_length, '[0-9]+' AS pattern
  UNION ALL SELECT '牌号', FALSE, 1, 8, 'Brand#[0-9]+'
  UNION ALL SELECT '物资名称', TRUE, 3, 11, '') h ON h.target <> ''
WHERE t.level = 3
""")

VIEWS["review_tasks"] = (("orders",), """
SELECT o_orderkey AS task_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'data_validation' WHEN 1 THEN 'category_match' ELSE 'field_mapping' END AS task_type,
  o_custkey AS entity_id,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
  CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 2 = 0 THEN 'assigned' ELSE 'in_progress' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'user'||CAST(o_custkey % 20 AS STRING) END AS assignee,
  'task '||CAST(o_orderkey AS STRING) AS title, 'check '||o_orderpriority AS description,
  o_orderdate AS created_at, o_orderdate + INTERVAL 30 DAY AS due_at,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS assigned_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 9 DAY END AS completed_at,
  CASE WHEN o_orderstatus = 'F' THEN 'approved' END AS resolution
FROM {orders}
""")
VIEWS["review_events"] = (("events",), """
SELECT event_id, ts, user_id AS task_id,
  CASE event_type WHEN 'signup' THEN 'assign' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'cancel' WHEN 'click' THEN 'reopen' ELSE 'reassign' END AS action,
  'user'||CAST(user_id % 20 AS STRING) AS user_id,
  CASE WHEN event_type = 'purchase' AND value < 5 THEN '' ELSE 'fixed' END AS resolution
FROM {events}
""")
VIEWS["callbacks"] = (("events",), """
SELECT ts,
  CASE WHEN value < 1 THEN '{{"taskId":"T'||CAST(user_id % 40 AS STRING)||'","status":"failed"}}'
  ELSE '{{"taskId":"T'||CAST(user_id % 40 AS STRING)||'","status":"'||CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END
  ||'","stats":{{"total":'||CAST(user_id AS STRING)||',"high":'||CAST(user_id % 7 AS STRING)||',"low":'||CAST(user_id % 3 AS STRING)||',"accuracy":0.5}}'
  ||',"results":[{{"index":'||CAST(user_id % 10 AS STRING)||',"categoryCode":"'||event_type||'","categoryName":"name '||event_type||'","confidence":0.5'
  ||',"extractedAttrs":{{"规格":"'||event_type||'","牌号":null}},"missingAttrs":["物资名称"],"needsReview":'||CASE event_type WHEN 'click' THEN 'true' ELSE 'false' END||'}}'
  ||CASE WHEN event_type = 'view' THEN ',{{"categoryCode":"noindex"}}' ELSE '' END||']}}' END AS payload
FROM {events}
""")
VIEWS["questions"] = (("conversations", "taxonomy"), """
WITH codes AS (SELECT category_code, category_name, row_number() OVER (PARTITION BY level ORDER BY id) AS rn, count(*) OVER (PARTITION BY level) AS n FROM {taxonomy} WHERE level = 2),
last_turn AS (SELECT conv_id, max(turn) AS turn FROM {conversations} WHERE role = 'user' AND length(text) > 0 GROUP BY conv_id),
asked AS (SELECT c.conv_id, c.text FROM {conversations} c JOIN last_turn l ON c.conv_id = l.conv_id AND c.turn = l.turn AND c.role = 'user')
SELECT a.conv_id, CASE a.conv_id % 4 WHEN 0 THEN '编码 '||k.category_code||' 是什么' WHEN 1 THEN '一级分类有哪些' WHEN 2 THEN '和 '||k.category_name||' 相似的物料' ELSE a.text END AS question
FROM asked a JOIN codes k ON k.rn = 1 + a.conv_id % k.n
""")


_RESPONSE = """'{{"score": '||{score}||', "matched": '||{matched}||', "bestMatchCode": "'||{code}||'", "reason": "'||{reason}||'"}}'"""
_R = {k: _RESPONSE.replace("{score}", a).replace("{matched}", b).replace("{code}", c).replace("{reason}", d) for k, (a, b, c, d) in {
    "plain": ("'92'", "'true'", "coalesce(col1,'')", "'名称一致 '||coalesce(col1,'')"),
    "fenced": ("'\"55\"'", "'\"false\"'", "' 100101 '", "'应为 100101'"),
    "escape": ("'70'", "'true'", "''", "'牌号 45'||chr(92)||'C'"),
    "against": ("'30'", "'true'", "'100102'", "'系统分类正确'"),
    "range": ("'250'", "'false'", "'ZZ'", "'无'"),
    "recode": ("'20'", "'false'", "'100101'", "'应为 100101'")}.items()}
VIEWS["responses"] = (("raw_rows",), f"""
SELECT row_id, CASE row_id % 7 WHEN 0 THEN 'plain' WHEN 1 THEN 'fenced' WHEN 2 THEN 'escape' WHEN 3 THEN 'text' WHEN 4 THEN 'against' WHEN 5 THEN 'range' ELSE 'recode' END AS kind,
 CASE row_id % 7 WHEN 0 THEN {_R['plain']} WHEN 1 THEN '```json'||chr(10)||{_R['fenced']}||chr(10)||'```' WHEN 2 THEN {_R['escape']} WHEN 3 THEN '无法判断'
  WHEN 4 THEN '结论：'||{_R['against']}||' 以上' WHEN 5 THEN {_R['range']} ELSE {_R['recode']} END AS response
FROM {{raw_rows}}
""")
VIEWS["extract_responses"] = (("raw_rows",), """
SELECT row_id, CASE WHEN col5 IS NULL OR col5 = '' THEN 'no answer' ELSE '```json'||chr(10)||'{{"物资 名称":"'||col4||'","规格型号":"'||col3||'","other":"x","牌号":null,"单位":"'||col6||'"}}'||chr(10)||'```' END AS response
FROM {raw_rows}
""")
