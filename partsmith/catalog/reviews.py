"""Queries over review tasks."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.cleaned import cleaned
from partsmith.catalog.oracle import cte
from partsmith.catalog.scalars import NOW, now
from partsmith.operators import review as R, search as Q
from partsmith.session import shared_dir

_weight = "CASE priority WHEN 'urgent' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 3 ELSE 1 END"

cte("event_fold", "review_tasks review_events", """
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS n FROM review_events WHERE task_id IN (SELECT task_id FROM review_tasks)),
s AS (SELECT task_id, CAST(0 AS BIGINT) AS n, status, assignee, CAST(NULL AS BIGINT) AS event_id, TRUE AS ok, resolution, completed_at, assigned_at FROM review_tasks WHERE task_id IN (SELECT task_id FROM e)
 UNION ALL
 SELECT task_id, n, CASE WHEN ok THEN to_status ELSE status END, CASE WHEN NOT ok THEN assignee WHEN action IN ('assign','reassign') THEN user_id WHEN action = 'reopen' THEN NULL ELSE assignee END, event_id, ok,
  CASE WHEN ok AND action = 'complete' THEN new_resolution WHEN ok AND action = 'reopen' THEN NULL ELSE resolution END,
  CASE WHEN ok AND action = 'complete' THEN ts WHEN ok AND action = 'reopen' THEN NULL ELSE completed_at END,
  CASE WHEN ok AND action IN ('assign','reassign') THEN ts WHEN ok AND action = 'reopen' THEN NULL ELSE assigned_at END
 FROM (SELECT s.task_id, e.n, s.status, s.assignee, s.resolution, s.completed_at, s.assigned_at, e.event_id, e.action, e.user_id, e.ts, e.resolution AS new_resolution,
   CASE e.action WHEN 'assign' THEN 'assigned' WHEN 'reassign' THEN 'assigned' WHEN 'start' THEN 'in_progress' WHEN 'complete' THEN 'completed' WHEN 'cancel' THEN 'cancelled' ELSE 'pending' END AS to_status,
   CASE e.action WHEN 'assign' THEN s.status = 'pending' WHEN 'reassign' THEN s.status IN ('assigned','in_progress') WHEN 'start' THEN s.status = 'assigned' AND s.assignee IS NOT DISTINCT FROM e.user_id
    WHEN 'complete' THEN s.status = 'in_progress' AND s.assignee IS NOT DISTINCT FROM e.user_id AND trim(e.resolution) <> '' WHEN 'cancel' THEN s.status IN ('pending','assigned') ELSE s.status IN ('completed','cancelled') END AS ok
   FROM s JOIN e ON e.task_id = s.task_id AND e.n = s.n + 1))
SELECT * FROM s
""")


def folded(t):
    if "folded" not in t._made:
        t._made["folded"] = R.apply_events(t["review_tasks"], t["review_events"])
    return t._made["folded"]


@query("rv_apply_events", """SELECT t.task_id, coalesce(l.status, t.status) AS status, CASE WHEN l.task_id IS NULL THEN t.assignee ELSE l.assignee END AS assignee, CASE WHEN l.task_id IS NULL THEN t.resolution ELSE l.resolution END AS resolution,
 CASE WHEN l.task_id IS NULL THEN t.completed_at ELSE l.completed_at END AS completed_at, CASE WHEN l.task_id IS NULL THEN t.assigned_at ELSE l.assigned_at END AS assigned_at
 FROM review_tasks t LEFT JOIN (SELECT * FROM event_fold QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC) = 1) l USING (task_id)""")
def _(t):
    return folded(t)[0].select("task_id", "status", "assignee", "resolution", "completed_at", "assigned_at")


@query("rv_rejected_events", "SELECT event_id, task_id, action FROM review_events WHERE event_id NOT IN (SELECT event_id FROM event_fold WHERE event_id IS NOT NULL AND ok)")
def _(t):
    return folded(t)[1].where("not accepted").select("event_id", "task_id", "action")


@query("rv_create", """SELECT row_id AS entity_id, 'category_match' AS task_type, CASE WHEN match_confidence < 0.7 THEN 'high' WHEN match_confidence < 0.9 THEN 'medium' ELSE 'low' END AS priority, 'pending' AS status,
 '分类审核 - 数据 #'||row_id||' ('||printf('%.1f', match_confidence * 100)||'% 置信度)' AS title FROM cleaned""")
def _(t):
    return R.create(R.category_audits(cleaned(t)))[0].select("entity_id", "task_type", "priority", "status", "title")


@query("rv_create_rejected", "SELECT c.row_id AS entity_id, 'title missing' AS problems FROM cleaned c WHERE material_name = ''")
def _(t):
    wanted = R.category_audits(cleaned(t)).drop("title").join(
        cleaned(t).select(F.col("row_id").alias("entity_id"), F.col("material_name").alias("title")), "entity_id")
    return R.create(wanted)[1].select("entity_id", F.array_join("problems", ";").alias("problems"))


@query("rv_mapping_audits", "SELECT std_id * 1000 + title_id AS entity_id, CASE WHEN confidence < 0.7 THEN 'high' WHEN confidence < 0.9 THEN 'medium' ELSE 'low' END AS priority, source FROM mapping")
def _(t):
    from partsmith.catalog.mappings import mappings

    m = mappings(t).withColumn("ident", F.col("std_id") * 1000 + F.col("title_id"))
    return m.select(F.col("ident").alias("entity_id"), R.priority_for(F.col("confidence")).alias("priority"), "source")


@query("flt_tasks", "SELECT task_id, title FROM review_tasks WHERE (contains(title, '77') OR contains(description, '77')) AND status IN ('pending','assigned') AND priority IN ('high','urgent') AND created_at >= TIMESTAMP '1996-01-01'")
def _(t):
    return R.search_tasks(t["review_tasks"], "77", ("pending", "assigned"), ("HIGH", "urgent"),
                          created=(dt.datetime(1996, 1, 1), None)).select("task_id", "title")


@query("srt_tasks", f"SELECT row_number() OVER (ORDER BY {_weight} DESC, due_at NULLS FIRST, created_at DESC, task_id) - 1 AS place, task_id, priority, due_at FROM review_tasks")
def _(t):
    return R.place_by_urgency(t["review_tasks"]).select("place", "task_id", "priority", "due_at")


@query("rv_queues", """SELECT 'my_pending' AS queue, task_id FROM review_tasks WHERE assignee = 'user3' AND status IN ('assigned','in_progress') UNION ALL SELECT 'my_completed', task_id FROM review_tasks WHERE assignee = 'user3' AND status = 'completed'
 UNION ALL SELECT 'unassigned', task_id FROM review_tasks WHERE status = 'pending' UNION ALL SELECT 'in_progress', task_id FROM review_tasks WHERE status = 'in_progress' UNION ALL SELECT 'assigned', task_id FROM review_tasks WHERE assignee = 'user3'""")
def _(t):
    out = [R.queue(t["review_tasks"], q, "user3").select(F.lit(q).alias("queue"), "task_id")
           for q in ("my_pending", "my_completed", "unassigned", "in_progress", "assigned")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query("rv_due", f"SELECT task_id, due_at < {NOW} AS overdue, due_at >= {NOW} AS due_soon FROM review_tasks WHERE status IN ('pending','assigned','in_progress') AND due_at <= {NOW} + INTERVAL 48 HOUR")
def _(t):
    return R.due(t["review_tasks"], now(), 48).select("task_id", "overdue", "due_soon")


@query("rv_reminders", f"""WITH m AS (SELECT * FROM review_tasks WHERE assignee = 'user3' AND status IN ('assigned','in_progress'))
 SELECT task_id, 'due_soon' AS type, CAST(trunc(epoch(due_at - {NOW}) / 3600) AS BIGINT) AS amount FROM m WHERE due_at >= {NOW} AND due_at < {NOW} + INTERVAL 24 HOUR
 UNION ALL SELECT task_id, 'high_priority', {_weight} FROM m WHERE priority IN ('high','urgent')
 UNION ALL SELECT task_id, 'long_pending', CAST(trunc(epoch({NOW} - assigned_at) / 86400) AS BIGINT) FROM m WHERE status = 'assigned' AND assigned_at < {NOW} - INTERVAL 2 DAY""")
def _(t):
    return R.reminders(t["review_tasks"], now(), "user3")


@query("rv_history", """SELECT task_id, 'create' AS type, created_at AS at, '任务创建' AS detail FROM review_tasks UNION ALL SELECT task_id, 'assign', assigned_at, '分配给 '||assignee FROM review_tasks WHERE assigned_at IS NOT NULL
 UNION ALL SELECT task_id, 'status_change', coalesce(completed_at, assigned_at, created_at), '状态变更为 '||status FROM review_tasks UNION ALL SELECT task_id, 'complete', completed_at, '任务完成，解决方式: '||resolution FROM review_tasks WHERE completed_at IS NOT NULL""".replace("AS at,", 'AS "at",'))
def _(t):
    return R.history(t["review_tasks"])


@query("rv_auto_assign", """WITH l AS (SELECT assignee, count(*) FILTER (status IN ('pending','assigned','in_progress')) AS load FROM review_tasks WHERE assignee IS NOT NULL GROUP BY assignee),
 p AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS n FROM review_tasks WHERE status = 'pending'), c AS (SELECT count(*) AS total FROM p),
 r AS (SELECT assignee, load, row_number() OVER (ORDER BY load, assignee) AS k, sum(load) OVER (ORDER BY load, assignee) AS s FROM l),
 u AS (SELECT assignee, load, k, count(*) OVER () AS kk, sum(load) OVER () + total AS held FROM r, c WHERE k * load - s <= total),
 q AS (SELECT assignee, k, held // kk - load + CASE WHEN k <= held % kk THEN 1 ELSE 0 END AS quota FROM u),
 b AS (SELECT assignee, sum(quota) OVER (ORDER BY k) - quota AS low, sum(quota) OVER (ORDER BY k) AS high FROM q)
 SELECT p.task_id, b.assignee FROM p JOIN b ON p.n >= b.low AND p.n < b.high""")
def _(t):
    return R.auto_assign(t["review_tasks"])


@query("rv_batch_status", "SELECT row_id, CASE WHEN match_source = 'UNMATCHED' THEN 'rejected' ELSE status END AS status, CASE WHEN match_source = 'UNMATCHED' THEN 'user1' END AS reviewer FROM cleaned")
def _(t):
    edits = cleaned(t).where("match_source = 'UNMATCHED'").select(
        "row_id", F.lit("rejected").alias("status"), F.lit("user1").alias("reviewer"), F.lit("no category").alias("comment"))
    return R.set_status(cleaned(t), edits, "row_id").select("row_id", "status", "reviewer")


@query("rv_report", "SELECT task_id, status, priority FROM review_tasks WHERE status = 'in_progress'")
def _(t):
    path = f"{shared_dir(t.spark)}/report-{uuid.uuid4().hex}"
    R.search_tasks(t["review_tasks"], statuses=("in_progress",)).select("task_id", "status", "priority").write.partitionBy("priority").parquet(path)
    return t.spark.read.parquet(path).select("task_id", "status", "priority")


cte("approvals", "events", """SELECT CAST(CASE WHEN event_id % 50 = 0 THEN -1 ELSE user_id END AS BIGINT) AS task_id, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'u'||CAST(event_id % 7 AS VARCHAR) END AS user_id,
 CASE event_id % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'hold' WHEN 3 THEN 'other' ELSE '' END AS result,
 CASE WHEN event_id % 3 = 0 THEN 'c'||CAST(event_id AS VARCHAR) END AS comments, ts AS done_at, event_id AS seq FROM events""")


def approvals(t):
    return t["events"].selectExpr(
        "cast(CASE WHEN event_id % 50 = 0 THEN -1 ELSE user_id END AS BIGINT) AS task_id",
        "CASE WHEN event_id % 11 = 0 THEN ' ' ELSE concat('u', event_id % 7) END AS user_id",
        "CASE event_id % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'hold' WHEN 3 THEN 'other' ELSE '' END AS result",
        "CASE WHEN event_id % 3 = 0 THEN concat('c', event_id) END AS comments", "ts AS at", "event_id AS seq")


@query("rv_approve", """WITH g AS (SELECT * FROM approvals WHERE trim(user_id) <> '' AND result <> '' AND task_id IN (SELECT task_id FROM review_tasks)),
 m AS (SELECT task_id, arg_max(CASE result WHEN 'approve' THEN 'completed' ELSE 'pending' END, (done_at, seq)) FILTER (result IN ('approve', 'reject', 'hold')) AS s,
   arg_max(CASE result WHEN 'approve' THEN 'approved' ELSE 'rejected' END, (done_at, seq)) FILTER (result IN ('approve', 'reject')) AS resolution,
   arg_max(user_id, (done_at, seq)) FILTER (result = 'approve') AS completed_by, count(*) FILTER (comments IS NOT NULL) AS n_notes,
   arg_max(comments, (done_at, seq)) FILTER (comments IS NOT NULL) AS last_note FROM g GROUP BY task_id)
 SELECT t.task_id, coalesce(m.s, t.status) AS status, m.resolution, m.completed_by, coalesce(m.n_notes, 0) AS n_notes, m.last_note FROM review_tasks t LEFT JOIN m USING (task_id)""")
def _(t):
    done = R.apply_approvals(t["review_tasks"].drop("resolution", "completed_by", "description"), approvals(t))[0]
    notes = F.split(F.col("description"), "\n\n")
    return done.select("task_id", "status", "resolution", "completed_by", F.coalesce(F.size(notes), F.lit(0)).cast("long").alias("n_notes"),
                       F.regexp_extract(F.element_at(notes, -1), "]: (.*)$", 1).alias("last_note"))


@query("rv_approve_refused", """SELECT task_id, done_at, CASE WHEN trim(user_id) = '' THEN 'blank user' WHEN result = '' THEN 'blank result' ELSE 'missing task' END AS reason
 FROM approvals WHERE trim(user_id) = '' OR result = '' OR task_id NOT IN (SELECT task_id FROM review_tasks)""")
def _(t):
    return R.apply_approvals(t["review_tasks"], approvals(t))[1].withColumnRenamed("at", "done_at")


@query("rv_select", "SELECT task_id FROM review_tasks WHERE task_type = (SELECT min(task_type) FROM review_tasks) AND priority = 'high' AND status = 'completed'")
def _(t):
    kind = t["review_tasks"].agg(F.min("task_type")).first()[0]
    return R.select_tasks(t["review_tasks"], task_type=kind, priority="high", status="completed").select("task_id")


@query("rv_quality", """WITH i AS (SELECT row_id, 1 AS place, 'no name' AS what, material_name = '' AS hit FROM cleaned UNION ALL SELECT row_id, 2, 'no grade', grade = '' FROM cleaned)
 SELECT row_id AS entity_id, 'data_validation' AS task_type, 'medium' AS priority, '数据质量检查 - cleaned #'||row_id||' ('||count(*)||' 个问题)' AS title,
  '数据质量检查任务'||chr(10)||chr(10)||'实体类型: cleaned'||chr(10)||'实体ID: '||row_id||chr(10)||chr(10)||'发现问题:'||chr(10)||string_agg(n||'. '||what||chr(10)||'   严重程度: low'||chr(10), '' ORDER BY place) AS description
 FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY place) AS n FROM i WHERE hit) GROUP BY row_id""")
def _(t):
    c = cleaned(t)
    issue = lambda place, what, hit: c.where(hit).select(
        F.lit("cleaned").alias("entity_type"), F.col("row_id").alias("entity_id"), F.lit(None).cast("string").alias("priority"),
        F.lit(place).alias("place"), F.lit(what).alias("description"), F.lit("low").alias("severity"), F.lit(None).cast("string").alias("field"))
    both = issue(1, "no name", "material_name = ''").unionByName(issue(2, "no grade", "grade = ''"))
    return R.quality_tasks(both).select("entity_id", "task_type", "priority", "title", "description")
