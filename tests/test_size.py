"""Work that has to grow with the rows: how tables are dealt out, what is never broadcast, timers without a call per task."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from partsmith.catalog import base, matching, registry, streams
from partsmith.catalog.tables import Tables
from partsmith.operators import checks, export, ingest, library, matcher, retrieval
from partsmith.session import new_path, stage
from partsmith.streaming import callbacks as C
from partsmith.streaming.tables import each_batch, run_available
from conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_views_are_dealt_out(spark):
    t = Tables(spark, SF)
    for name in ("raw_rows", "review_tasks", "review_events", "callbacks"):
        assert len(t[name].inputFiles()) > 1, name


def test_codes_need_no_pairs(spark, monkeypatch):
    t = Tables(spark, SF)
    monkeypatch.setattr(matching, "parts", lambda t: 1 / 0)
    monkeypatch.setattr(base, "tables", lambda spark, sf_dir: t)
    assert registry.queries()["join_prefix"](spark, SF).count() > 0


def test_matcher_makes_only_what_is_asked_for(spark, monkeypatch):
    t = Tables(spark, SF)
    monkeypatch.setattr(base, "tables", lambda spark, sf_dir: t)
    with monkeypatch.context() as m:
        m.setattr(matcher, "name_pairs", lambda *a: 1 / 0)
        assert registry.queries()["mt_synonym"](spark, SF).count() > 0
    with monkeypatch.context() as m:
        m.setattr(matcher, "name_scores", lambda *a: 1 / 0)
        assert all(registry.queries()[q](spark, SF).count() > 0 for q in ("cl_name_pairs", "mt_ancestors", "mt_boost"))
    given = []
    monkeypatch.setattr(matcher, "top_candidates", lambda *a: 1 / 0)
    monkeypatch.setattr(matcher, "name_scores", lambda *a, made=matcher.name_scores: given.append(a) or made(*a))
    assert all(registry.queries()[q](spark, SF).count() > 0 for q in ("join_match", "mt_rank")) and len(given) == 1


def test_cells_of_a_header_are_not_broadcast(spark):
    raw = stage(spark.range(3000).selectExpr("id AS row_id", "0L AS title_id", "'x' AS col1", "'y' AS col2"), "raw")
    header = spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "title_id long, pos int, name string")
    std = spark.createDataFrame([(7, 1, "t")], "std_id long, pos int, target string")
    results = stage(spark.range(3000).selectExpr("7L AS std_id", "id AS row_id", "'v' AS col1"), "results")
    out = export.results_by_header(results, raw, header, std)
    assert "SortMergeJoin [row_id" in plan(out) and out.count() == 9000


def test_words_of_rows_are_not_broadcast(spark):
    rows = stage(spark.range(500).selectExpr("id AS row_id", "'steel bolt' AS material_name", "string(id) AS specification", "'' AS full_description", "'' AS grade"), "rows")
    asked = spark.createDataFrame([(1, "和 bolt 相似的物料"), (2, "442 bolt")], "conv_id long, question string")
    out = retrieval.similar(asked, rows)
    assert plan(out).count("SortMergeJoin [row_id") == 2 and "ShuffledHashJoin [gram" in plan(out)
    best = {r.conv_id: (r.row_id, r.score) for r in out.where("place = 1").collect()}
    assert best == {1: (499, 1.0), 2: (442, 1.0)}


def test_texts_of_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(library, "TEXTS_A_TASK", 100)
    tree = spark.createDataFrame([(i, f"C{i}", f"steel,bolt{i}", 3) for i in range(12)], "id long, category_code string, category_name string, level int")
    idx = library.build_indexes(tree, spark.createDataFrame([], "category_id long, synonym_name string"))
    rows = stage(spark.range(1000).selectExpr("id AS row_id", "if(id < 900, 'steel', 'bolt7') AS material_name", "if(id = 3, 'C9', null) AS category_code"), "rows")
    out = library.recall(rows, tree, idx, k=4)
    assert "SortMergeJoin [text_key" in plan(out) and "hashpartitioning(row_id" in plan(out) and ", 11)" in plan(out)
    found = {}
    for r in out.collect():
        found.setdefault(r.row_id, []).append((r.rank, r.category_code, r.relevance))
    steel = [(1, "C0", 0.51), (2, "C1", 0.51), (3, "C10", 0.51), (4, "C11", 0.51)]
    assert sorted(found[3]) == [(1, "C9", 1.0), (2, "C0", 0.51), (3, "C1", 0.51), (4, "C10", 0.51)]
    assert all(sorted(found[i]) == steel for i in range(900) if i != 3) and all(found[i] == [(1, "C7", 0.51)] for i in range(900, 1000))


def test_free_text_is_read_once(spark, monkeypatch):
    given, recall = [], library.recall
    monkeypatch.setattr(library, "recall", lambda rows, *a: given.append(rows.columns) or recall(rows, *a))
    tree = spark.createDataFrame([(1, "C1", "steel,bolt", 3)], "id long, category_code string, category_name string, level int")
    idx = library.build_indexes(tree, spark.createDataFrame([], "category_id long, synonym_name string"))
    texts = spark.createDataFrame([(1, "Steel, Bolt"), (2, "..ſ🙂"), (3, "一bolt.x")], "text_id long, text string")
    out = {r.text_id: (r.code, r.relevance, r.n_candidates) for r in checks.classify_text(texts, tree, idx).collect()}
    assert out == {1: ("C1", 0.95, 1), 2: (None, None, 0), 3: (None, None, 0)} and given == [["row_id", "full_description"]]


def test_keys_of_files_are_counted_from_staged_rows(spark, monkeypatch):
    given, count = [], ingest.first_seen_keys
    monkeypatch.setattr(base, "tables", Tables)
    monkeypatch.setattr(ingest, "first_seen_keys", lambda items: given.append(plan(items)) or count(items))
    assert registry.queries()["win_first_seen_keys"](spark, SF).count() > 0
    assert "Join" not in given[0]  # behind a join by file, all rows of a file would be parsed in one task


def test_parts_arrive_in_order_as_many_files(spark):
    t, found = Tables(spark, SF), []
    look = [F.min("ts"), F.max("ts"), F.count("*"), F.count_distinct("file")]
    streams.arrive(t, "review_events", "ts", lambda stream: each_batch(stream, lambda batch, i: found.append((i, *batch.withColumn("file", F.input_file_name()).agg(*look).first())), new_path(spark, "ckpt")))
    assert [f[0] for f in found] == [0, 1, 2, 3] and all(f[4] > 1 for f in found)
    assert all(a[2] < b[1] for a, b in zip(found, found[1:])) and sum(f[3] for f in found) == t["review_events"].count()


def watch(spark, batches, late="10 minutes"):
    start = datetime(2024, 1, 1)
    path, out = new_path(spark, "watch-in"), new_path(spark, "watch-out")
    schema = "task_id string, ts timestamp, kind string"
    for rows in batches:
        spark.createDataFrame([(k, start + timedelta(minutes=m), kind) for k, m, kind in rows], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    run_available(C.watch_timeouts(stream, out, new_path(spark, "watch-state"), new_path(spark, "ckpt"), late=late))
    found = spark.read.schema(C.TIMEOUT_OUT).parquet(out)
    return sorted((r.task_id, r.status, r.batch) for r in found.collect())


def test_timers(spark):
    found = watch(spark, [
        [("silent", 0, "submit"), ("heard", 0, "submit"), ("heard", 5, "callback"), ("early", 3, "callback"), ("soon", 30, "submit")],
        [("early", 8, "submit"), ("heard", 20, "callback"), ("twice", 20, "submit"), ("soon", 41, "callback"), ("tick", 40.0, "callback")],
        [("tock", 41.0, "callback"), ("twice", 39, "submit")],
        [("end", 200, "submit")],
    ])
    assert found == [("early", "callback_received", 0), ("heard", "callback_received", 0), ("silent", "callback_timeout", 1), ("soon", "callback_received", 1),
                     ("tick", "callback_received", 1), ("tock", "callback_received", 2), ("twice", "callback_timeout", 3)]
