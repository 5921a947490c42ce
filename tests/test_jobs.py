import datetime as dt
import random

from pyspark.sql import functions as F

from partsmith.catalog.cleaned import cleaned
from partsmith.operators import review, scoring, taxonomy as X
from partsmith.sources import files


def test_every_row_cleaned_once(t):
    c = cleaned(t)
    assert c.count() == t["raw_rows"].count() == c.select("row_id").distinct().count()
    assert c.where("category_id is not null and category_level <> 3").count() == 0
    assert c.where("match_source = 'UNMATCHED' and category_id is not null").count() == 0
    assert c.where("status not in ('needs_review','approved','export_ready')").count() == 0


def test_duplicates_keep_one_per_fingerprint(t):
    c = cleaned(t)
    kept = c.where("is_duplicate = 0").count()
    assert kept == c.select("title_id", "source_row_hash").distinct().count()
    again = scoring.flag_duplicates(c.drop("is_duplicate").repartition(5)).select("row_id", "is_duplicate")
    assert again.exceptAll(c.select("row_id", "is_duplicate")).count() == 0


def test_review_fold_does_not_depend_on_segments(spark):
    rnd = random.Random(7)
    actions = ["assign", "start", "complete", "cancel", "reopen", "reassign"]
    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(minutes=rnd.randint(0, 5000)), rnd.randint(1, 6), rnd.choice(actions),
               rnd.choice(["u1", "u2", "u3", None]), rnd.choice(["ok", "", None])) for i in range(600)]
    ev = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, task_id long, action string, user_id string, resolution string")
    tasks = spark.createDataFrame(
        [(i, "pending", None, None, None, None) for i in range(1, 6)],
        "task_id long, status string, assignee string, resolution string, completed_at timestamp_ntz, assigned_at timestamp_ntz")

    state = {i: ["pending", None] for i in range(1, 6)}
    accepted = set()
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        i, _, task, action, user, res = e
        if task not in state:
            continue
        st, who = state[task]
        ok = {"assign": st == "pending" and bool(user), "reassign": st in ("assigned", "in_progress") and bool(user),
              "start": st == "assigned" and who == user, "complete": st == "in_progress" and who == user and bool(res),
              "cancel": st in ("pending", "assigned"), "reopen": st in ("completed", "cancelled")}[action]
        if ok:
            accepted.add(i)
            new = {"assign": "assigned", "reassign": "assigned", "start": "in_progress", "complete": "completed", "cancel": "cancelled", "reopen": "pending"}[action]
            state[task] = [new, user if action in ("assign", "reassign") else None if action == "reopen" else who]
    for size, fan in ((1, 2), (7, 4), (64, 64), (10**6, 64)):
        out, judged = review.apply_events(tasks, ev, size, fan)
        assert {r["task_id"]: [r["status"], r["assignee"]] for r in out.collect()} == state
        assert {r["event_id"] for r in judged.where("accepted").collect()} == accepted
        assert judged.count() == len(events)


def test_moves_that_close_a_cycle_together(spark):
    tax = spark.createDataFrame(
        [(1, "10", "a", None, 1, "/10", 0), (2, "11", "b", None, 1, "/11", 1), (3, "1001", "c", 1, 2, "/10/1001", 0), (4, "1101", "d", 2, 2, "/11/1101", 0)],
        "id long, category_code string, category_name string, parent_id long, level int, full_path string, sort_order int")
    edits = spark.createDataFrame([(1, 4), (2, 3)], "id long, new_parent_id long")
    out, rejected = X.move(tax, edits)
    assert {(r["id"], r["reason"]) for r in rejected.collect()} == {(1, "cycle"), (2, "cycle")}
    assert {r["id"]: r["full_path"] for r in out.collect()}[3] == "/10/1001"


def test_a_busy_day_of_one_task_is_cut(spark, monkeypatch):
    """All events of one task in one second: no list is longer than a segment, and the state is that of a plain loop."""
    n, longest = 3000, {}
    actions = ["assign", "start", "complete", "reopen", "reassign"]
    ev = spark.range(n).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("ts"), F.lit(1).cast("long").alias("task_id"),
        F.element_at(F.array(*map(F.lit, actions)), (F.xxhash64("id") % 5 + 5).cast("int") % 5 + 1).alias("action"),
        F.concat(F.lit("u"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).cast("string")).alias("user_id"), F.lit("ok").alias("resolution"))
    tasks = spark.createDataFrame([(1, "pending", None, None, None, None)],
                                  "task_id long, status string, assignee string, resolution string, completed_at timestamp_ntz, assigned_at timestamp_ntz")
    keep = review.stage

    def stage(df, label):
        out = keep(df, label)
        column = {"review_segments": "ev", "review_chains": "chain"}.get(label)
        if column:
            longest[label] = max(longest.get(label, 0), out.agg(F.max(F.size(column))).first()[0])
        return out

    monkeypatch.setattr(review, "stage", stage)
    got = review.apply_events(tasks, ev, 16, 8)
    st, who, accepted = "pending", None, set()
    for e in ev.orderBy("event_id").collect():
        ok = {"assign": st == "pending", "reassign": st in ("assigned", "in_progress"), "start": st == "assigned" and who == e.user_id,
              "complete": st == "in_progress" and who == e.user_id, "reopen": st == "completed"}[e.action]
        if ok:
            accepted.add(e.event_id)
            who = e.user_id if e.action in ("assign", "reassign") else None if e.action == "reopen" else who
            st = {"assign": "assigned", "reassign": "assigned", "start": "in_progress", "complete": "completed", "reopen": "pending"}[e.action]
    row = got[0].first()
    assert (row.status, row.assignee) == (st, who) and len(accepted) > 500
    assert {r.event_id for r in got[1].where("accepted").collect()} == accepted
    assert longest["review_segments"] <= 16 and longest["review_chains"] <= 8


def test_csv_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text("编码 , ,数量\n1, x ,2.0\n,,\n3,y,5\n", encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "a.csv"), 9)
    assert [r["name"] for r in got.header.orderBy("pos").collect()][0] == "编码"
    assert [(r["col1"], r["col2"], r["col3"]) for r in got.rows.orderBy("row_id").collect()] == [("1", "x", "2"), ("3", "y", "5")]
    assert got.counts.first()["total_rows"] == 2


def test_dynamic_overwrite_replaces_only_its_file(spark, tmp_path):
    path = str(tmp_path / "runs")
    old = spark.createDataFrame([(1, 1), (2, 2)], "title_id long, v long")
    files.replace_partitions(old, path)
    files.replace_partitions(old.where("title_id = 2").withColumn("v", F.lit(9).cast("long")), path)
    assert {(r["title_id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, 1), (2, 9)}


def test_stream_merges_twice_the_same(spark, tmp_path):
    """Two micro-batches, a repeated payload and a human decision."""
    from partsmith.catalog.externals import ROW_SCHEMA
    from partsmith.streaming import callbacks as C
    from partsmith.streaming.tables import KeyedTable, run_available

    def payload(code, index):
        return ('{"taskId":"T1","status":"processing","results":[{"index":%d,"categoryCode":"%s"}]}' % (index, code))

    folder = str(tmp_path / "in")
    schema = "ts timestamp_ntz, payload string"
    at = dt.datetime(2024, 1, 1)
    rows = KeyedTable(spark, str(tmp_path / "rows"), spark.createDataFrame(
        [("T1", 1, "old", None, None, None, None, False, "accepted")], ROW_SCHEMA), ["task_id", "row_index"])
    tasks = KeyedTable(spark, str(tmp_path / "tasks"), spark.createDataFrame(
        [("T1", "processing", at, None, 0)], "task_id string, status string, submitted_at timestamp_ntz, callback_at timestamp_ntz, retry_count int"), ["task_id"])
    log = KeyedTable(spark, str(tmp_path / "log"), spark.createDataFrame([], "task_id string, digest string, ts timestamp_ntz, result string"), ["digest"], append=True)
    for minute, body in ((0, payload("a", 1)), (1, payload("a", 1)), (2, payload("b", 2))):
        spark.createDataFrame([(at + dt.timedelta(minutes=minute), body)], schema).write.mode("append").parquet(folder)
        run_available(C.ingest(spark.readStream.schema(schema).parquet(folder), rows, tasks, log, str(tmp_path / "ckpt")))
    got = {r["row_index"]: (r["category_code"], r["row_status"]) for r in rows.latest().collect()}
    assert got == {1: ("a", "accepted"), 2: ("b", "completed")}
    assert log.latest().count() == 2
