"""Queries over counts, statistics and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from partsmith.catalog.base import query
from partsmith.catalog.cleaned import cleaned
from partsmith.catalog.searches import batches, log, low_samples
from partsmith.functions import scores as S
from partsmith.operators import reports as R

NOW = "TIMESTAMP '1998-06-01 00:00:00'"
NOW_COL = lambda: F.expr("TIMESTAMP_NTZ'1998-06-01 00:00:00'")


@query("agg_status", """SELECT 'cleaned' AS source, title_id, status, count(*) AS n FROM cleaned GROUP BY title_id, status
UNION ALL SELECT 'task', NULL, status, count(*) FROM review_tasks GROUP BY status UNION ALL SELECT 'batch', NULL, status, count(*) FROM export_batches GROUP BY status
UNION ALL SELECT 'file', NULL, status, count(*) FROM raw_title GROUP BY status""")
def _(t):
    def tagged(name, df):
        if "title_id" not in df.columns:
            df = df.withColumn("title_id", F.lit(None).cast("long"))
        return df.select(F.lit(name).alias("source"), "title_id", "status", "n")

    return (
        tagged("cleaned", R.by_status(cleaned(t), "title_id")).unionByName(tagged("task", R.by_status(t["review_tasks"])))
        .unionByName(tagged("batch", R.by_status(batches(t)))).unionByName(tagged("file", R.by_status(t["raw_title"]))))


@query("agg_category", "SELECT category_id, category_code, category_name, count(*) AS n FROM cleaned WHERE category_id IS NOT NULL GROUP BY ALL")
def _(t):
    return R.by_category(cleaned(t), t["taxonomy"])


@query("agg_category_top", "SELECT category_id, category_code, category_name, count(*) AS n FROM cleaned WHERE category_id IS NOT NULL GROUP BY ALL ORDER BY n DESC, category_code LIMIT 10")
def _(t):
    return R.by_category(cleaned(t), t["taxonomy"], 10)


@query("agg_category_title_top", """SELECT title_id, category_id, category_code, category_name, count(*) AS n, CAST(row_number() OVER (PARTITION BY title_id ORDER BY count(*) DESC, category_code) AS INTEGER) AS place
 FROM cleaned WHERE category_id IS NOT NULL GROUP BY ALL QUALIFY place <= 10""".replace("GROUP BY ALL", "GROUP BY title_id, category_id, category_code, category_name"))
def _(t):
    return R.by_category_per_title(cleaned(t), t["taxonomy"])


@query("agg_format", "SELECT format, count(*) AS n FROM export_batches GROUP BY format")
def _(t):
    return batches(t).groupBy("format").agg(F.count("*").alias("n"))


@query("agg_task_type", "SELECT task_type, count(*) AS n FROM review_tasks GROUP BY task_type")
def _(t):
    return t["review_tasks"].groupBy("task_type").agg(F.count("*").alias("n"))


@query("agg_assignee", "SELECT assignee, status, count(*) AS n FROM review_tasks WHERE assignee IS NOT NULL GROUP BY assignee, status")
def _(t):
    return R.by_status(t["review_tasks"].where("assignee is not null"), "assignee")


@query("agg_sum_rows", "SELECT CAST(coalesce(sum(total_rows), 0) AS BIGINT) AS total FROM raw_title")
def _(t):
    return R.total_rows(t["raw_title"])


@query("agg_avg_score", "SELECT floor(avg(quality_score) * 10 + 0.5) / 10 AS avg_score FROM cleaned")
def _(t):
    return R.average_score(cleaned(t))


def _listed(entry: str, order: str) -> str:
    return f"CAST(to_json(list({entry} ORDER BY {order})) AS VARCHAR)"


_counted = ("cleaned", "unmatched", "duplicates", "filled", "failed", "low_confidence", "needs_review", "approved", "export_ready")
_zeroed = ", ".join(f"CAST(coalesce(g.{n}, 0) AS BIGINT) AS {n}" for n in _counted)
_paired = ", ".join("CAST(to_json([" + ", ".join(
    f"{{'name': '{R.PAIR_NAMES[n]}', 'value': CAST({v} AS BIGINT)}}" for n, v in pair) + f"]) AS VARCHAR) AS {name}" for name, pair in (
    ("match_distribution", (("matched", "greatest(0, coalesce(g.cleaned - g.unmatched, 0))"), ("unmatched", "coalesce(g.unmatched, 0)"))),
    ("fill_distribution", (("filled", "coalesce(g.filled, 0)"), ("failed", "coalesce(g.failed, 0)")))))
_same = "ON {0}.scope = s.scope AND {0}.title_id IS NOT DISTINCT FROM s.title_id"


@query("agg_dashboard", f"""WITH s AS (SELECT 'file' AS scope, title_id, min(file_name) AS file_name, count(*) AS files, sum(total_rows) AS total_rows FROM raw_title GROUP BY title_id
   UNION ALL SELECT 'all', NULL, NULL, count(*), sum(total_rows) FROM raw_title),
 h AS (SELECT s.scope, c.* REPLACE (s.title_id AS title_id) FROM s JOIN cleaned c ON s.scope = 'all' OR c.title_id IS NOT DISTINCT FROM s.title_id),
 g AS (SELECT scope, title_id, count(*) AS cleaned, count(*) FILTER (match_source = 'UNMATCHED') AS unmatched, sum(is_duplicate) AS duplicates, sum(quality_score) AS ss, count(quality_score) AS sc,
   count(*) FILTER (category_code IN (SELECT category_code FROM std_header)) AS filled, count(*) FILTER (category_code IS NOT NULL AND category_code NOT IN (SELECT category_code FROM std_header)) AS failed,
   count(*) FILTER (match_source IN ('UNMATCHED','FUZZY_AMBIGUOUS')) AS low_confidence,
   count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'export_ready') AS export_ready FROM h GROUP BY scope, title_id),
 u AS (SELECT scope, title_id, {_listed("{'status': status, 'n': n}", "n DESC, status NULLS LAST")} AS status_distribution
   FROM (SELECT scope, title_id, status, count(*) AS n FROM h GROUP BY scope, title_id, status) GROUP BY scope, title_id),
 k AS (SELECT scope, title_id, {_listed("{'category_id': category_id, 'category_code': category_code, 'category_name': category_name, 'n': n}", "n DESC, category_code NULLS LAST, category_id NULLS LAST")} AS category_distribution
   FROM (SELECT scope, title_id, category_id, category_code, category_name, count(*) AS n FROM h GROUP BY scope, title_id, category_id, category_code, category_name
    QUALIFY row_number() OVER (PARTITION BY scope, title_id ORDER BY count(*) DESC, category_code NULLS LAST, category_id NULLS LAST) <= 10) GROUP BY scope, title_id)
 SELECT s.scope, s.title_id, s.file_name, s.files, CAST(coalesce(s.total_rows, 0) AS BIGINT) AS total_rows, {_zeroed}, floor(g.ss / g.sc * 10 + 0.5) / 10 AS avg_score,
  CAST(greatest(0, coalesce(g.cleaned - g.unmatched, 0)) AS BIGINT) AS matched, coalesce(u.status_distribution, '[]') AS status_distribution,
  coalesce(k.category_distribution, '[]') AS category_distribution, {_paired}
 FROM s LEFT JOIN g {_same.format("g")} LEFT JOIN u {_same.format("u")} LEFT JOIN k {_same.format("k")}""")
def _(t):
    from partsmith.catalog.mappings import failed, results

    out = R.dashboard(t["raw_title"], t["raw_rows"], cleaned(t), results(t), failed(t), low_samples(t), t["taxonomy"])
    return out.withColumns({n: F.to_json(n, {"ignoreNullFields": "false"}) for n in out.columns if n.endswith("_distribution")})


@query("agg_quality_report", "SELECT count(*) AS total, avg(quality_score) AS avg_score FROM cleaned WHERE title_id = 1")
def _(t):
    return R.quality_report(cleaned(t), 1)


@query("agg_cleaning_stats", "SELECT r.title_id, r.file_name, r.total_rows, r.status, coalesce(c.n, 0) AS cleaned_rows FROM raw_title r LEFT JOIN (SELECT title_id, count(*) AS n FROM cleaned GROUP BY title_id) c USING (title_id)")
def _(t):
    return R.cleaning_stats(t["raw_title"], cleaned(t))


@query("agg_distinct_codes", "SELECT title_id, category_code, min(row_id) AS first_id FROM cleaned WHERE category_code <> '' GROUP BY title_id, category_code")
def _(t):
    return R.distinct_codes(cleaned(t))


@query("agg_counts", "SELECT title_id, count(*) FILTER (match_source = 'UNMATCHED') AS unmatched, count(*) FILTER (is_duplicate = 1) AS duplicates, count(*) FILTER (quality_score < 60) AS below_review FROM cleaned GROUP BY title_id")
def _(t):
    return R.count_where(cleaned(t), {
        "unmatched": F.col("match_source") == "UNMATCHED", "duplicates": F.col("is_duplicate") == 1,
        "below_review": F.col("quality_score") < 60}, "title_id")


@query("agg_category_stats", """SELECT t.id AS category_id, coalesce(k.n, 0) AS child_count, coalesce(d.n, 0) AS data_count FROM taxonomy t
 LEFT JOIN (SELECT parent_id, count(*) AS n FROM taxonomy GROUP BY parent_id) k ON k.parent_id = t.id LEFT JOIN (SELECT category_id, count(*) AS n FROM cleaned GROUP BY category_id) d ON d.category_id = t.id""")
def _(t):
    return R.category_stats(t["taxonomy"], cleaned(t))


@query("agg_category_tree_stats", """SELECT t.id AS category_id, count(c.row_id) AS total, count(*) FILTER (c.status IN ('approved','export_ready')) AS valid, count(*) FILTER (c.status = 'needs_review') AS pending, max(c.created_at) AS last_update
 FROM taxonomy t LEFT JOIN cleaned_log c ON c.category_full_path = t.full_path OR starts_with(c.category_full_path, t.full_path||'/') GROUP BY t.id""")
def _(t):
    from partsmith.operators.taxonomy import closure

    return R.category_tree_stats(closure(t["taxonomy"]).select(F.col("root_id").alias("ancestor_id"), "id"), log(t))


_stat = "count(*) AS n, CAST(sum(total_records) AS BIGINT) AS records, CAST(sum(exported_records) AS BIGINT) AS exported, CAST(sum(file_size) AS BIGINT) AS bytes, CAST(floor(avg(file_size)) AS BIGINT) AS mean_bytes, count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*) AS success_pct FROM export_batches WHERE created_at >= TIMESTAMP '1997-01-01'"


@query("agg_export_stats", f"SELECT 'all' AS dimension, CAST(NULL AS VARCHAR) AS value, {_stat} " + " ".join(
    f"UNION ALL SELECT '{d}', {d}, {_stat} GROUP BY {d}" for d in ("status", "format", "batch_type", "created_by")))
def _(t):
    return R.export_stats(batches(t), F.expr("TIMESTAMP_NTZ'1997-01-01 00:00:00'"))


_open = "status IN ('pending','assigned','in_progress')"


@query("agg_task_stats", "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in R.TASK_STATES) + ", "
       + ", ".join(f"count(*) FILTER (task_type = '{s}') AS {s}" for s in R.TASK_TYPES)
       + f""", count(*) FILTER (assignee = 'user7' AND status IN ('assigned','in_progress')) AS my_pending, count(*) FILTER (assignee = 'user7' AND status = 'completed') AS my_completed,
 count(*) FILTER ({_open} AND due_at >= {NOW} AND due_at <= {NOW} + INTERVAL 24 HOUR) AS due_soon, count(*) FILTER ({_open} AND due_at < {NOW}) AS overdue FROM review_tasks""")
def _(t):
    return R.task_stats(t["review_tasks"], NOW_COL(), "user7")


@query("agg_task_user_stats", "SELECT assignee, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in R.TASK_STATES) + " FROM review_tasks WHERE assignee IS NOT NULL GROUP BY assignee")
def _(t):
    return R.task_user_stats(t["review_tasks"])


@query("agg_workload", """WITH p AS (SELECT assignee, count(*) AS n FROM review_tasks WHERE assignee IS NOT NULL GROUP BY assignee), m AS (SELECT *, avg(n) OVER () AS mean_n FROM p)
SELECT assignee, n, mean_n, CASE WHEN n > 1.5 * mean_n THEN 'overloaded' WHEN n > 0 AND n < 0.5 * mean_n THEN 'idle' ELSE 'normal' END AS load_class FROM m""")
def _(t):
    return R.workload(t["review_tasks"])


@query("agg_ext_stats", """WITH v AS (SELECT ts, payload, json_extract_string(payload, '$.taskId') AS task_id FROM callbacks WHERE json_extract(payload, '$.stats') IS NOT NULL),
 l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC) = 1)
 SELECT task_id, CAST(json_extract_string(payload, '$.stats.total') AS BIGINT) AS total, CAST(json_extract_string(payload, '$.stats.high') AS BIGINT) AS high,
 CAST(json_extract_string(payload, '$.stats.low') AS BIGINT) AS low, CAST(json_extract_string(payload, '$.stats.accuracy') AS DOUBLE) AS accuracy FROM l""")
def _(t):
    from partsmith.operators.external import latest_stats

    return latest_stats(t["callbacks"])


@query("fn_round1", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 10 + 0.5) / 10 AS price FROM lineitem")
def _(t):
    return t["lineitem"].select("l_orderkey", "l_linenumber", S.round1(F.col("l_extendedprice")).alias("price"))
