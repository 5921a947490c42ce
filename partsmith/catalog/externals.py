"""Queries over external result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.oracle import cte
from partsmith.operators import external as X, search as Q

from partsmith.session import new_path
ROW_SCHEMA = ("task_id string, row_index int, category_code string, category_name string, confidence double, "
              "attrs map<string,string>, missing array<string>, needs_review boolean, row_status string")


def tasks(t):
    """Tasks named by even users of the events; the rest of the callbacks is unknown."""
    users = t["events"].groupBy(F.concat(F.lit("T"), (F.col("user_id") % 40).cast("string")).alias("task_id")).agg(
        F.min("ts").alias("submitted_at"), F.min("user_id").alias("u"))
    return t.keep("ext_tasks", lambda: users.where("u % 8 <> 3").select(
        "task_id", F.lit("processing").alias("status"), "submitted_at", F.lit(None).cast("timestamp_ntz").alias("callback_at"),
        F.lit(0).alias("retry_count")))


def stored(t):
    """Rows the tasks already hold: some accepted by hand."""
    return t.keep("ext_stored", lambda: tasks(t).select(
        "task_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(11))).alias("row_index")).select(
        "task_id", "row_index", F.lit("old").alias("category_code"), F.lit("old name").alias("category_name"), F.lit(0.1).alias("confidence"),
        F.create_map(F.lit("规格"), F.lit("旧")).alias("attrs"), F.array(F.lit("牌号"), F.lit("单位")).alias("missing"),
        F.lit(True).alias("needs_review"), F.when(F.col("row_index") == 1, "accepted").otherwise("pending").alias("row_status")))


def payloads(t):
    return t.keep("ext_payloads", lambda: X.once(t["callbacks"]).drop("body")).withColumn("body", F.from_json("payload", X.PAYLOAD))


def ext_rows(t):
    return t.keep("ext_rows", lambda: X.upsert_rows(
        stored(t), X.result_items(payloads(t)).join(tasks(t).select("task_id"), "task_id", "left_semi")))


cte("ext_task", "events", "SELECT 'T'||(user_id % 40) AS task_id, min(ts) AS submitted_at FROM events GROUP BY 1 HAVING min(user_id) % 8 <> 3")
cte("ext_once", "callbacks", """
SELECT payload, min(ts) AS ts, sha256(payload) AS digest, json_extract_string(payload, '$.taskId') AS task_id, json_extract_string(payload, '$.status') AS status FROM callbacks GROUP BY payload
""")
cte("ext_item", "ext_once ext_task", """
SELECT task_id, ts, CAST(json_extract_string(payload, '$.results[0].index') AS INTEGER) AS row_index, json_extract_string(payload, '$.results[0].categoryCode') AS category_code,
 json_extract_string(payload, '$.results[0].categoryName') AS category_name, json_extract_string(payload, '$.results[0].needsReview') = 'true' AS needs_review
FROM ext_once WHERE json_extract(payload, '$.results') IS NOT NULL AND task_id IN (SELECT task_id FROM ext_task)
""")
cte("ext_row", "ext_item ext_task", """
WITH n AS (SELECT * FROM ext_item QUALIFY row_number() OVER (PARTITION BY task_id, row_index ORDER BY ts DESC) = 1),
o AS (SELECT task_id, unnest([0, 1, 11]) AS row_index FROM ext_task)
SELECT coalesce(n.task_id, o.task_id) AS task_id, CAST(coalesce(n.row_index, o.row_index) AS INTEGER) AS row_index, coalesce(n.category_code, 'old') AS category_code, coalesce(n.category_name, 'old name') AS category_name,
 coalesce(n.needs_review, TRUE) AS needs_review, CASE WHEN o.row_index = 1 THEN 'accepted' WHEN n.task_id IS NULL THEN 'pending' ELSE 'completed' END AS row_status,
 n.task_id IS NOT NULL AS arrived FROM n FULL JOIN o ON n.task_id = o.task_id AND n.row_index = o.row_index
""")


@query("ex_rows", "SELECT task_id, row_index, category_code, category_name, needs_review, row_status FROM ext_row")
def _(t):
    return ext_rows(t).select("task_id", "row_index", "category_code", "category_name", "needs_review", "row_status")


@query("ex_task_states", """WITH l AS (SELECT task_id, CASE WHEN status IN ('completed','failed','cancelled') THEN status ELSE 'processing' END AS status, ts FROM ext_once QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, digest DESC) = 1)
 SELECT t.task_id, coalesce(l.status, 'processing') AS status, l.ts AS callback_at FROM ext_task t LEFT JOIN l USING (task_id)""")
def _(t):
    return X.task_states(tasks(t), payloads(t)).select("task_id", "status", "callback_at")


@query("st_callback_log", "SELECT task_id, digest, ts, 'success' AS result FROM ext_once WHERE task_id IN (SELECT task_id FROM ext_task)")
def _(t):
    return X.callback_log(payloads(t), tasks(t))


@query("st_timeout", "SELECT task_id, CASE WHEN submitted_at <= TIMESTAMP '2024-01-01 03:00:00' - INTERVAL 30 MINUTE THEN 'callback_timeout' ELSE 'processing' END AS status FROM ext_task")
def _(t):
    return X.timed_out(tasks(t), F.expr("TIMESTAMP_NTZ'2024-01-01 03:00:00'")).select("task_id", "status")


@query("flt_ext_rows", "SELECT task_id, row_index, category_code FROM ext_row WHERE task_id = 'T5' AND needs_review ORDER BY row_index LIMIT 20")
def _(t):
    found = X.page_of_rows(ext_rows(t), "T5", 1, 20, doubtful=True)
    return found.select("task_id", "row_index", "category_code")


@query("set_attr_union", """SELECT category_code, k.key, min(task_id||'#'||lpad(CAST(row_index AS VARCHAR), 6, '0')) AS first_seen FROM ext_row
 CROSS JOIN (SELECT unnest(['规格','牌号','物资名称','单位']) AS key) k WHERE CASE k.key WHEN '单位' THEN NOT arrived WHEN '物资名称' THEN arrived ELSE TRUE END GROUP BY category_code, k.key""")
def _(t):
    seen = F.concat("first_task", F.lit("#"), F.lpad(F.col("first_index").cast("string"), 6, "0"))
    return X.attr_union(ext_rows(t)).select("category_code", "key", seen.alias("first_seen"))


def ext_header(t):
    """A standard header for the categories the events name."""
    kinds = t["events"].select(F.col("event_type").alias("category_code")).distinct()
    return kinds.select("category_code", F.posexplode(F.array(F.lit("牌号"), F.lit("产地"), F.lit("物资名称"))).alias("pos", "target"))


@query("snk_rows_by_category", """WITH u AS (SELECT DISTINCT r.task_id, r.category_name, k.key FROM ext_row r CROSS JOIN (SELECT unnest(['规格','牌号','物资名称','单位']) AS key) k WHERE CASE k.key WHEN '单位' THEN NOT arrived WHEN '物资名称' THEN arrived ELSE TRUE END
  UNION SELECT DISTINCT r.task_id, r.category_name, k.key FROM ext_row r CROSS JOIN (SELECT unnest(['牌号','物资名称','产地']) AS key) k WHERE r.category_code <> 'old')
 SELECT r.category_name AS category, r.task_id, r.row_index, u.key, CASE WHEN u.key = '规格' THEN CASE WHEN arrived THEN r.category_code ELSE '旧' END ELSE '' END AS value FROM ext_row r JOIN u USING (task_id, category_name)""")
def _(t):
    path = new_path(t.spark, "by-category")
    X.write_by_category(X.rows_by_category(ext_rows(t).drop("snapshot"), ext_header(t)), path)
    return t.spark.read.parquet(path).select("category", "task_id", "row_index", "key", "value")


@query("flt_ext_tasks", "SELECT task_id, 'processing' AS status FROM ext_task ORDER BY submitted_at DESC, task_id LIMIT 5 OFFSET 5")
def _(t):
    return X.list_tasks(tasks(t), 2, 5, "processing", "submittedAt").select("task_id", "status")


def cells(t):
    maps = Q.row_map(t["raw_rows"], t["raw_header"]).join(t["raw_rows"].select("row_id", "row_index"), "row_id")
    return maps.select(F.concat(F.lit("F"), F.col("title_id").cast("string")).alias("task_id"), "row_id", "row_index", F.to_json("cells").alias("snapshot"))


@query("ex_submit_rows", """SELECT 'F'||title_id AS task_id, row_id, row_number() OVER (PARTITION BY title_id ORDER BY row_index, row_id) - 1 + CASE WHEN title_id = 2 THEN 5 ELSE 0 END AS row_index, 'pending' AS row_status, 'async' AS mode,
 '{"分类编码":"'||coalesce(col1,'')||'","类别名称":"'||coalesce(col2,'')||'","物料代码":"'||coalesce(col3,'')||'","品牌":"'||coalesce(col4,'')||'","全描述":"'||coalesce(col5,'')||'","计量单位":"'||coalesce(col6,'')||'"}' AS snapshot FROM raw_rows""")
def _(t):
    held = t["raw_title"].where("status = 'processing'").select(
        F.concat(F.lit("F"), F.col("title_id").cast("string")).alias("task_id"), F.lit(4).cast("long").alias("row_index"))
    return X.submit_rows(cells(t), held, 10)


def decisions(t):
    """Two decisions on every row of two categories, in the order of ``seq``, and whole tasks."""
    rows = ext_rows(t)
    none = F.lit(None).cast("string")

    def decide(kind, seq, action, code):
        return rows.where(F.col("category_code") == kind).select(
            "task_id", "row_index", F.lit(action).alias("action"), F.lit(code).cast("string").alias("code"), none.alias("name"), none.alias("comment"), F.lit(seq).alias("seq"))

    whole = tasks(t).where("task_id in ('T1', 'T2')").select("task_id", F.lit(None).cast("int").alias("row_index"), F.lit("accept").alias("action"),
                                                             none.alias("code"), none.alias("name"), none.alias("comment"), F.lit(0).alias("seq"))
    return decide("view", 1, "reject", None).unionByName(decide("view", 2, "correct", "fixed")).unionByName(
        decide("error", 2, "reject", None)).unionByName(decide("error", 1, "correct", "tried")).unionByName(whole)


@query("ex_adopt", """SELECT task_id, row_index, CASE category_code WHEN 'view' THEN 'fixed' WHEN 'error' THEN 'tried' ELSE category_code END AS category_code, category_name,
 CASE WHEN category_code = 'view' THEN 'corrected' WHEN category_code = 'error' THEN 'rejected' WHEN task_id IN ('T1','T2') AND row_status IN ('completed','pending') THEN 'accepted' ELSE row_status END AS row_status FROM ext_row""")
def _(t):
    return X.decide(ext_rows(t), decisions(t)).select("task_id", "row_index", "category_code", "category_name", "row_status")


@query("ex_fill_missing", """SELECT task_id, row_index, CASE WHEN arrived THEN '' ELSE '牌号,单位' END AS missing, CASE WHEN arrived THEN FALSE ELSE needs_review END AS needs_review,
 CASE WHEN arrived THEN 'filled' END AS name_value, CASE WHEN arrived THEN 'first' END AS origin_value FROM ext_row""")
def _(t):
    open_rows = ext_rows(t).where(F.array_contains("missing", "物资名称")).select("task_id", "row_index")
    first = open_rows.select("*", F.create_map(F.lit("物资名称"), F.lit("draft"), F.lit("产地"), F.lit("first")).alias("given"), F.lit(1).alias("seq"))
    second = open_rows.select("*", F.create_map(F.lit("物资名称"), F.lit("filled"), F.lit("牌号"), F.lit(None).cast("string")).alias("given"), F.lit(2).alias("seq"))
    return X.fill_missing(ext_rows(t), second.unionByName(first)).select(
        "task_id", "row_index", F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"), "needs_review",
        F.try_element_at("attrs", F.lit("物资名称")).alias("name_value"), F.try_element_at("attrs", F.lit("产地")).alias("origin_value"))


@query("ex_retry", """WITH l AS (SELECT task_id, status FROM ext_once QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, digest DESC) = 1), f AS (SELECT task_id FROM ext_task JOIN l USING (task_id) WHERE status = 'failed')
 SELECT r.task_id, r.row_index, CASE WHEN f.task_id IS NOT NULL AND row_status NOT IN ('accepted','corrected') THEN 'pending' ELSE row_status END AS row_status,
 CASE WHEN f.task_id IS NOT NULL AND row_status NOT IN ('accepted','corrected') THEN NULL ELSE category_code END AS category_code FROM ext_row r LEFT JOIN f USING (task_id)""")
def _(t):
    return X.retry(ext_rows(t), X.task_states(tasks(t), payloads(t)))[0].select("task_id", "row_index", "row_status", "category_code")


@query("ex_retry_tasks", """WITH l AS (SELECT task_id, CASE WHEN status IN ('completed','failed','cancelled') THEN status ELSE 'processing' END AS status FROM ext_once QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, digest DESC) = 1)
 SELECT t.task_id, CASE WHEN l.status = 'failed' THEN 'submitting' ELSE coalesce(l.status, 'processing') END AS status, CASE WHEN l.status = 'failed' THEN 1 ELSE 0 END AS retry_count FROM ext_task t LEFT JOIN l USING (task_id)""")
def _(t):
    return X.retry(ext_rows(t), X.task_states(tasks(t), payloads(t)))[1].select("task_id", "status", "retry_count")


@query("ex_delete", """WITH l AS (SELECT task_id, status FROM ext_once QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, digest DESC) = 1),
 g AS (SELECT task_id FROM ext_task JOIN l USING (task_id) WHERE status IN ('completed','failed','cancelled') AND task_id IN ('T0','T1','T2','T4'))
 SELECT 'tasks' AS name, count(*) AS n FROM ext_task WHERE task_id NOT IN (SELECT task_id FROM g) UNION ALL SELECT 'rows', count(*) FROM ext_row WHERE task_id NOT IN (SELECT task_id FROM g)
 UNION ALL SELECT 'log', count(*) FROM ext_once WHERE task_id IN (SELECT task_id FROM ext_task) AND task_id NOT IN (SELECT task_id FROM g)""")
def _(t):
    states = X.task_states(tasks(t), payloads(t))
    ids = states.where("task_id in ('T0','T1','T2','T4')").select("task_id")
    out = X.delete(states, ext_rows(t), X.callback_log(payloads(t), tasks(t)), ids)
    named = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in zip(("tasks", "rows", "log"), out)]
    return named[0].unionByName(named[1]).unionByName(named[2])
