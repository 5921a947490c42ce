"""Several edits of one row, orders over all rows, shares of work."""

import random

import pytest
from pyspark.sql import functions as F

from partsmith.operators import export, external, mapping, review
from partsmith.operators.order import numbered

ROW = "task_id string, row_index int, category_code string, category_name string, attrs map<string,string>, missing array<string>, needs_review boolean, row_status string"


@pytest.fixture
def uncoalesced(spark):
    """Small data as many partitions, as large data would be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_decisions_in_order(spark):
    rows = spark.createDataFrame([("T", i, "c", "n", None, None, True, "completed") for i in range(4)] + [("U", 0, "c", "n", None, None, True, "rejected")], ROW)
    decisions = spark.createDataFrame(
        [("T", 0, "accept", None, None, 1), ("T", 0, "correct", "x", None, 2), ("T", 1, "correct", "x", "y", 1), ("T", 1, "correct", "z", None, 2), ("T", 1, "accept", None, None, 3),
         ("T", 2, "reject", None, None, 5), ("T", None, "accept", None, None, 9), ("U", None, "accept", None, None, 1)],
        "task_id string, row_index int, action string, code string, name string, seq int")
    got = {(r.task_id, r.row_index): (r.category_code, r.category_name, r.row_status) for r in external.decide(rows, decisions).collect()}
    assert got == {("T", 0): ("x", "n", "corrected"), ("T", 1): ("z", "y", "accepted"), ("T", 2): ("c", "n", "rejected"),
                   ("T", 3): ("c", "n", "accepted"), ("U", 0): ("c", "n", "rejected")}


def test_fills_add_up(spark):
    rows = spark.createDataFrame([("T", 0, "c", "n", {"a": "1", "k": None}, ["b", "c"], True, "completed"), ("T", 1, "c", "n", None, ["b"], True, "completed")], ROW)
    filled = spark.createDataFrame([("T", 0, {"b": "old"}, 1), ("T", 0, {"c": "3"}, 2), ("T", 0, {"b": "2", "a": None}, 3), ("T", 1, {}, 1)],
                                   "task_id string, row_index int, given map<string,string>, seq int")
    got = {r.row_index: r for r in external.fill_missing(rows, filled).collect()}
    assert len(got) == 2 and got[0].attrs == {"a": "", "k": "", "b": "2", "c": "3"}
    assert (got[0].missing, got[0].needs_review, got[1].missing, got[1].needs_review) == (None, False, ["b"], True)


def test_last_stamp_and_last_mapping(spark):
    cleaned = spark.createDataFrame([(1, None, None), (2, 5, None)], "id long, export_batch_id long, exported_at timestamp")
    stamps = spark.sql("SELECT * FROM VALUES (1L, 9L, timestamp'2024-01-02'), (1L, 8L, timestamp'2024-01-03') AS v(id, batch_id, at)")
    assert {(r.id, r.export_batch_id) for r in export.mark_exported(cleaned, stamps).collect()} == {(1, 8), (2, 5)}
    auto = spark.createDataFrame([(1, 1, "temp_data", s, 1, t, "auto", 0.5, "pending") for s, t in (("A", "x"), ("B", "y"), ("C", "z"))],
                                 "title_id long, std_id long, source_type string, source string, source_pos int, target string, mapping_type string, confidence double, status string")
    edits = spark.createDataFrame([(1, 1, "x", "P", None, 1), (1, 1, "x", "Q", "temp_data", 2), (1, 1, "y", "P", None, 1), (1, 1, "y", "", None, 2),
                                   (1, 1, "z", " ", None, 1), (1, 1, "z", "R", "extra_data", 2)], "title_id long, std_id long, target string, source string, source_type string, seq int")
    kept, cleared = mapping.merge_manual(auto, edits)
    assert sorted((r.target, r.source, r.source_type) for r in kept.collect()) == [("x", "Q", "temp_data"), ("z", "R", "extra_data")]
    assert sorted(r.target for r in cleared.collect()) == ["y", "z"]


def test_wide_results_keep_their_order(spark, tmp_path, uncoalesced):
    n = 150
    header = spark.createDataFrame([(1, i, f"h{i}") for i in range(1, n + 1)], "title_id long, pos int, name string")
    raw = spark.createDataFrame([(1, r, *[f"{r}-{i}" for i in range(1, n + 1)]) for r in range(40)], "title_id long, row_id long, " + ", ".join(f"col{i} string" for i in range(1, n + 1)))
    std = spark.createDataFrame([(7, 1, "t1"), (7, 2, "t2")], "std_id long, pos int, target string")
    results = spark.createDataFrame([(1, r, 7, "a", "b") for r in range(40)], "title_id long, row_id long, std_id long, col1 string, col2 string")
    cells = export.results_by_header(results, raw, header, std)
    export.write_by_header(cells, str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "std_id=7").glob("*.parquet"))
    got = [(r.row_id, r.name) for f in files for r in spark.read.parquet(str(f)).collect()]
    assert got == [(r, name) for r in range(40) for name in [f"原始-h{i}" for i in range(1, n + 1)] + ["t1", "t2"]]
    assert len(files) > 1  # one large header is several files in order


def test_a_large_sheet_is_several_files(spark, tmp_path, uncoalesced):
    sheets = spark.range(9000).selectExpr("'T' task_id", "if(id % 3 = 0, '未分类', concat('k', id % 300)) category", "id row_index", "explode(array(1, 2)) pos", "'key' key", "'v' value")
    external.write_by_category(sheets, str(tmp_path / "out"))
    folder = tmp_path / "out" / "task_id=T"
    files = sorted(folder.glob("category=未分类/*.parquet"))
    assert len(files) > 1
    rows = [[(r.row_index, r.pos) for r in spark.read.parquet(str(f)).collect()] for f in files]
    assert sum(rows, []) == [(i, p) for i in range(0, 9000, 3) for p in (1, 2)]
    assert len(list(folder.glob("*/*.parquet"))) < 250  # small sheets are not cut up


def test_places_in_a_global_order(spark, uncoalesced):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "b"]), rng.random()) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "id long, k string, x double").repartition(7), [F.col("k").desc(), F.col("x").asc(), F.col("id").asc()]).collect()
    want = sorted(rows, key=lambda r: ({"b": 0, "a": 1, None: 2}[r[1]], r[2], r[0]))
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [r[0] for r in want] and sorted(r.place for r in got) == list(range(500))


def test_reviewers_fill_up_like_water(spark):
    rng = random.Random(3)
    for n, held in ((50, {"a": 100, "b": 1}), (5000, {f"r{i}": rng.randrange(400) for i in range(23)}), (3, {"a": 5, "b": 5, "c": 6}), (0, {"a": 1}), (7, {})):
        rows = [(i, "pending", None) for i in range(n)] + [(10_000 + 1000 * k + i, "assigned", r) for k, (r, c) in enumerate(held.items()) for i in range(c)]
        got = review.auto_assign(spark.createDataFrame(rows, "task_id long, status string, assignee string"), 64).collect()
        new = dict.fromkeys(held, 0)
        for r in got:
            new[r.assignee] += 1
        assert len({r.task_id for r in got}) == len(got) == (n if held else 0)
        for a in held:
            for b in held:
                if new[a]:
                    assert held[a] + new[a] <= held[b] + new[b] + 1
