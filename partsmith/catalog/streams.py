"""Streaming queries, each run over everything that has arrived and then read as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from partsmith.catalog.base import query
from partsmith.catalog.cleaned import CORE_SQL
from partsmith.catalog.externals import stored, tasks
from partsmith.operators import cleaning
from partsmith.session import shared_dir
from partsmith.streaming import callbacks as C, rows as W
from partsmith.streaming.tables import KeyedTable, run_available


def fresh(t, label: str) -> str:
    return f"{shared_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


def arrive(t, name: str, by: str, work, parts: int = 4) -> None:
    """A view that arrives in ``parts``, in the order of ``by``; the writer ``work(stream)`` takes in each part before the next one comes.

    A part is as many files as its rows came in, all of one micro-batch.  The
    cuts decide where parts end, not what comes out, so they need not be exact.
    """
    path, writer = fresh(t, f"{name}-in"), None
    timed = dict(t[name].dtypes)[by].startswith("timestamp")
    at = F.col(by).cast("timestamp").cast("double") if timed else F.col(by).cast("double")
    cuts = t[name].agg(F.percentile_approx(at, [i / parts for i in range(1, parts)]).alias("q")).first()["q"] or []
    bounds = [None, *cuts, None]
    for low, high in zip(bounds[:-1], bounds[1:]):
        part = t[name] if low is None else t[name].where(at >= low)
        part = part if high is None else part.where(at < high)
        part.write.mode("append").parquet(path)
        if writer is None:
            writer = work(t.spark.readStream.schema(t[name].schema).parquet(path))
        run_available(writer)


@query("st_callback_ingest", "SELECT task_id, row_index, category_code, category_name, needs_review, row_status FROM ext_row")
def _(t):
    root = fresh(t, "ext")
    rows = KeyedTable(t.spark, f"{root}/rows", stored(t), ["task_id", "row_index"])
    states = KeyedTable(t.spark, f"{root}/tasks", tasks(t), ["task_id"])
    log_schema = "task_id string, digest string, ts timestamp_ntz, result string"
    log = KeyedTable(t.spark, f"{root}/log", t.spark.createDataFrame([], log_schema), ["digest"], append=True)
    arrive(t, "callbacks", "ts", lambda stream: C.ingest(stream, rows, states, log, f"{root}/ckpt"))
    return rows.latest().select("task_id", "row_index", "category_code", "category_name", "needs_review", "row_status")


@query("st_task_progress", """WITH d AS (SELECT DISTINCT payload FROM callbacks) SELECT json_extract_string(payload, '$.taskId') AS task_id, count(*) AS callbacks, CAST(sum(coalesce(json_array_length(payload, '$.results'), 0)) AS BIGINT) AS result_rows,
 count(*) FILTER (json_extract_string(payload, '$.status') = 'failed') AS errors, max(CAST(json_extract_string(payload, '$.stats.total') AS BIGINT)) AS total FROM d GROUP BY 1""")
def _(t):
    out, ckpt = fresh(t, "arrived"), fresh(t, "ckpt")
    arrive(t, "callbacks", "ts", lambda stream: C.arrivals(stream, "60 days").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ckpt))
    return C.progress(t.spark.read.parquet(out))


@query("st_late", """SELECT json_extract_string(payload, '$.taskId') AS task_id, arg_max(json_extract_string(payload, '$.status'), ts) AS status, max(ts) AS last_at FROM callbacks GROUP BY 1""")
def _(t):
    table = KeyedTable(t.spark, fresh(t, "statuses"), t.spark.createDataFrame([], C.STATUS), ["task_id"])
    arrive(t, "callbacks", "ts", lambda stream: C.last_status(stream, table, fresh(t, "ckpt")))
    return table.latest().select("task_id", "status", F.col("last_at").cast("timestamp_ntz").alias("last_at"))


@query("st_clean", f"SELECT {CORE_SQL} FROM cleaned")
def _(t):
    out = fresh(t, "cleaned-stream")
    none = t.spark.createDataFrame([], "title_id bigint, source_row_hash string")
    seen = KeyedTable(t.spark, fresh(t, "seen"), none, ["title_id", "source_row_hash"], append=True)
    arrive(t, "raw_rows", "row_id", lambda stream: W.clean(stream, t["raw_header"], t["taxonomy"], t["synonyms"], out, seen, fresh(t, "ckpt")), parts=3)
    return t.spark.read.parquet(out).select(*cleaning.CLEANED_COLUMNS)


@query("st_review", """SELECT t.task_id, coalesce(l.status, t.status) AS status, CASE WHEN l.task_id IS NULL THEN t.assignee ELSE l.assignee END AS assignee, CASE WHEN l.task_id IS NULL THEN t.resolution ELSE l.resolution END AS resolution
 FROM review_tasks t LEFT JOIN (SELECT * FROM event_fold QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY n DESC) = 1) l USING (task_id)""")
def _(t):
    table = KeyedTable(t.spark, fresh(t, "tasks"), t["review_tasks"], ["task_id"])
    arrive(t, "review_events", "ts", lambda stream: W.fold_reviews(stream, table, fresh(t, "ckpt")))
    return table.latest().select("task_id", "status", "assignee", "resolution")


# Each event is submitted at its time; two of three are answered five minutes later (some twice), one of seven five minutes before.
@query("st_watch_timeouts", """WITH e AS (SELECT event_id, ts, event_id % 3 <> 0 OR event_id % 7 = 0 AS heard FROM events),
 w AS (SELECT max(ts + CASE WHEN event_id % 3 <> 0 THEN INTERVAL 5 MINUTE ELSE INTERVAL 0 MINUTE END) - INTERVAL 10 MINUTE AS mark FROM events)
 SELECT 'T'||CAST(event_id AS VARCHAR) AS task_id, CASE WHEN heard THEN 'callback_received' ELSE 'callback_timeout' END AS status
 FROM e, w WHERE heard OR epoch_ms(ts) + 1800000 < epoch_ms(mark)""")
def _(t):
    at = F.col("ts").cast("timestamp")
    event = F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("task_id")
    later, before = at + F.expr("INTERVAL 5 MINUTES"), at - F.expr("INTERVAL 5 MINUTES")
    submit = t["events"].select(event, at.alias("ts"), F.lit("submit").alias("kind"))
    answer = t["events"].where("event_id % 3 <> 0").select(event, later.alias("ts"), F.lit("callback").alias("kind"))
    again = t["events"].where("event_id % 3 = 2").select(event, later.alias("ts"), F.lit("callback").alias("kind"))
    early = t["events"].where("event_id % 7 = 0").select(event, before.alias("ts"), F.lit("callback").alias("kind"))
    path, out = fresh(t, "watch-in"), fresh(t, "watch-out")
    rows = submit.unionByName(answer).unionByName(again).unionByName(early)
    cuts = [r["q"] for r in [rows.agg(F.percentile(F.unix_micros("ts"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).first()]][0]
    bounds = [None, *cuts, None]
    for low, high in zip(bounds[:-1], bounds[1:]):  # four files, in the order of their times
        part = rows if low is None else rows.where(F.unix_micros("ts") >= low)
        part = part if high is None else part.where(F.unix_micros("ts") < high)
        part.coalesce(1).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema("task_id string, ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(path)
    run_available(C.watch_timeouts(stream, out, fresh(t, "watch-state"), fresh(t, "ckpt")))
    return t.spark.read.schema(C.TIMEOUT_OUT).parquet(out).select("task_id", "status")
