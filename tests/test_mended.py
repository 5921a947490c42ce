"""Depth, width, identity and order: cases beyond what the derived views hold."""

from pyspark.sql import functions as F

from partsmith.operators import checks, cleaning, edits, export, external, ingest, library, mapping, matcher, review, search, taxonomy as X
from partsmith.session import new_path
from partsmith.sources import files

TREE = "id long, category_code string, category_name string, parent_id long, level int, full_path string, sort_order int"


def deep(spark, levels=6):
    rows = [(i, f"{i:02d}", f"n{i}", i - 1 if i > 1 else None, i, None, 0) for i in range(1, levels + 1)]
    return spark.createDataFrame(rows, TREE)


def test_six_levels_keep_their_paths(spark):
    tree = X.rebuild_paths(deep(spark))
    got = {r.id: (r.level, r.full_path) for r in tree.collect()}
    assert got[6] == (6, "/01/02/03/04/05/06")
    assert X.closure(deep(spark)).count() == 21
    below = X.subtree(deep(spark), spark.createDataFrame([(1,)], "root_id long")).collect()
    assert [r.node_id for r in sorted(below, key=lambda r: r.pos)] == [1, 2, 3, 4, 5, 6]


def test_circles_end(spark):
    ring = spark.createDataFrame([(1, "1", "a", 3, 1, None, 0), (2, "2", "b", 1, 2, None, 0), (3, "3", "c", 2, 3, None, 0)], TREE)
    assert X.closure(ring).count() == 9
    assert matcher.descendants(ring).select("ancestor_id").distinct().count() == 2


def test_climb_reaches_every_ancestor(spark):
    rows = [(i, f"{i:02d}", f"n{i}", i - 1 if i > 1 else None, 2 if i > 1 else 1, None, 0) for i in range(1, 6)]
    tree = spark.createDataFrame(rows + [(6, "06", "leaf", 5, 3, None, 0)], TREE)
    assert sorted((r.ancestor_id, r.hops) for r in matcher.descendants(tree).collect()) == [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]


def test_merge_chains_and_circles(spark):
    pairs = spark.createDataFrame([(10, 11), (11, 12), (20, 21), (21, 20), (30, 20), (5, 5), (7, 8), (8, 9), (9, 10)], "source_id long, target_id long")
    got = {r.source_id: r.target_id for r in X.resolve_pairs(pairs).collect()}
    assert got == {10: 12, 11: 12, 7: 12, 8: 12, 9: 12}
    tree = spark.createDataFrame([(10, "10", "a", None, 1, None, 0), (11, "11", "b", None, 1, None, 0), (12, "12", "c", None, 1, None, 0),
                                  (101, "1001", "x", 10, 2, None, 0)], TREE)
    rows = spark.createDataFrame([(1, 10, "10", 1, "/10", "a")], "row_id long, category_id long, category_code string, category_level int, category_full_path string, category_name string")
    kept, moved = X.merge(tree, rows, spark.createDataFrame([(10, 11), (11, 12)], "source_id long, target_id long"))
    assert {r.id: (r.parent_id, r.full_path) for r in kept.collect()} == {12: (None, "/12"), 101: (12, "/12/1001")}
    assert [(r.category_id, r.category_code) for r in moved.collect()] == [(12, "12")]


def test_last_edit_counts(spark):
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None), (None, 1, "x")], "k long, seq int, v string")
    assert {r.k: r.v for r in edits.last_edits(e, ["k"]).collect()} == {1: "b", 2: None}
    rows = spark.createDataFrame([(1, "open", "ann", "c1"), (2, "open", "bob", "c2")], "row_id long, status string, reviewer string, comment string")
    change = spark.createDataFrame([(1, 1, "x", "eve", None), (1, 2, "done", "joe", None)], "row_id long, seq int, status string, reviewer string, comment string")
    got = {r.row_id: (r.status, r.reviewer, r.comment) for r in review.set_status(rows, change, "row_id").collect()}
    assert got == {1: ("done", "joe", "c1"), 2: ("open", "bob", "c2")}
    cells = spark.createDataFrame([(1, 1, "a", "b", "new")], "row_id long, std_id long, col1 string, col2 string, status string")
    twice = spark.createDataFrame([(1, 1, 2, "y", 1), (1, 1, 2, "z", 2)], "row_id long, std_id long, pos int, value string, seq int")
    assert mapping.edit_results(cells, twice).first().col2 == "z"
    moved, rejected = X.move(deep(spark, 3), spark.createDataFrame([(3, 2, 1), (3, 1, 2)], "id long, new_parent_id long, seq int"))
    assert moved.count() == 3 and rejected.count() == 0 and {r.id: r.parent_id for r in moved.collect()}[3] == 1


def test_wide_header_keeps_all_targets(spark):
    targets = [(1, "10", i, f"T{i}", False) for i in range(1, 26)]
    head = spark.createDataFrame(targets, "std_id long, category_code string, pos int, target string, is_must boolean")
    raw = spark.createDataFrame([(1, 7, 2, *[f"v{i}" for i in range(1, 26)])], "title_id long, row_id long, row_index long, " + ", ".join(f"col{i} string" for i in range(1, 26)))
    header = spark.createDataFrame([(1, i, f"T{i}") for i in range(1, 26)], "title_id long, pos int, name string")
    maps = spark.createDataFrame([(1, 1, f"T{i}", f"T{i}", "auto", "temp_data", i) for i in range(1, 26)],
                                 "title_id long, std_id long, target string, source string, mapping_type string, source_type string, source_pos int")
    parsed = ingest.parsed_rows(raw, header)
    out = mapping.fill_all(spark.createDataFrame([(1, 7, "10")], "title_id long, row_id long, category_code string"), maps, parsed, header, head).first()
    assert [out[f"col{i}"] for i in range(1, 26)] == [f"v{i}" for i in range(1, 26)]


def test_thirty_keys(spark):
    desc = ";".join(f"k{i} v{i}" for i in range(30))
    raw = spark.createDataFrame([(1, 7, 2, desc)], "title_id long, row_id long, row_index long, col1 string")
    header = spark.createDataFrame([(1, 1, "全描述")], "title_id long, pos int, name string")
    row = ingest.extract_attrs(raw, header).first()
    assert row["attr30"] == "v29"


def test_two_files_keep_their_rows_apart(spark, tmp_path):
    for n, noun in ((1, "bolt"), (2, "nut")):
        (tmp_path / f"{n}.csv").write_text(f'编码,类别名称, ,全描述,全描述\n10{n},"{noun}\nsteel",,规格 1,规格 {n}\n10{n},{noun},x,,\n')
    both = files.together([files.read_csv(spark, str(tmp_path / f"{n}.csv"), n) for n in (1, 2)])
    rows = both.rows.collect()
    assert len({r.row_id for r in rows}) == 4 and sorted(r.row_index for r in rows) == [2, 2, 3, 3]
    assert {(r.title_id, r.col2) for r in rows} == {(1, "bolt\nsteel"), (1, "bolt"), (2, "nut\nsteel"), (2, "nut")}
    assert [r.name for r in sorted(both.header.where("title_id = 1").collect(), key=lambda r: r.pos)] == ["编码", "类别名称", "col3", "全描述", "全描述"]
    cells = {r.row_id: r.cells for r in search.row_map(both.rows, both.header).collect()}
    assert len(cells) == 4 and {c["全描述"] for c in cells.values()} == {"规格 1", "规格 2", ""}
    tree = spark.createDataFrame([(1, "10", "metal", None, 1, "/10", 0), (2, "101", "bolt", 1, 2, "/10/101", 0), (3, "10101", "bolt steel", 2, 3, "/10/101/10101", 0)], TREE)
    tree = tree.withColumns({c: F.lit(None).cast("string") for c in ("unit", "description", "old_code_1", "old_name_1")})
    syn = spark.createDataFrame([], "id long, category_id long, synonym_name string, synonym_norm string")
    out = cleaning.clean_rows(both.rows, both.header, tree, syn)
    assert out.count() == 4 and out.select("row_id").distinct().count() == 4


def test_exports_follow_id_order(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).select(F.col("id"), (F.col("id") % 7).alias("category_id"), F.lit("x").alias("status"))
        tree = spark.range(7).select("id", F.concat(F.lit("n"), "id").alias("category_name"))
        path = new_path(spark, "export")
        export.write_export(export.export_frame(rows, tree, export.ExportSpec(columns={"id": "id", "category_name": "name"})), path, "parquet")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    back = spark.read.parquet(path).select("id", F.input_file_name().alias("f")).collect()
    by = {}
    for r in back:
        by.setdefault(r.f, []).append(r.id)
    assert len(back) == 2000 and all(v == sorted(v) for v in by.values())
    spans = sorted((v[0], v[-1]) for v in by.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_recall_of_a_row_does_not_depend_on_others(spark):
    tree = spark.createDataFrame([(1, "01", "red bolt", None, 3, "/01", 0), (2, "02", "bolt", None, 3, "/02", 0)], TREE)
    syn = spark.createDataFrame([], "id long, category_id long, synonym_name string, synonym_norm string")
    idx = library.build_indexes(tree, syn, tokenise_first=True)
    rows = [(1, "red bolt"), (2, "redbolt")]
    one = library.recall(spark.createDataFrame(rows[:1], "row_id long, material_name string"), tree, idx, tokenise_first=True).collect()
    two = library.recall(spark.createDataFrame(rows, "row_id long, material_name string"), tree, idx, tokenise_first=True).where("row_id = 1").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and one


def test_new_synonyms_get_ids_after_the_known(spark):
    fixed = spark.createDataFrame([(9, "old a", "c1", "n1", "1"), (9, "old b", "c1", "n1", "1")], "category_id long, old_name string, category_code string, category_name string, old_code string")
    known = spark.createDataFrame([(41, 9, "other")], "id long, category_id long, synonym_name string")
    got = checks.feedback_synonyms(fixed, known).collect()
    assert len({r.id for r in got}) == 2 and min(r.id for r in got) > 41


def test_allowed_values(spark):
    attrs = spark.createDataFrame([(1, "10", "T", "red"), (2, "10", "T", "blue"), (3, "10", "T", None)], "row_id long, category_code string, target string, value string")
    rules = spark.createDataFrame([("10", "T", False, 1, 9, None, '["red"]')], "category_code string, target string, is_required boolean, min_length int, max_length int, pattern string, allowed string")
    none = spark.createDataFrame([], "category_code string, target string")
    assert [r.row_id for r in X.field_violations(attrs, rules, none).collect()] == [2]


def test_sheets_of_a_category(spark):
    rows = spark.createDataFrame([
        ("T", 0, "A", "10", {"k2": "x", "z": "1"}, ["m"], '{"c1":"r0","c2":"s0"}'), ("T", 1, "A", "10", {"a": "2"}, None, '{"c1":"r1"}'),
        ("T", 2, None, "20", {}, None, None), ("T", 3, " ", None, {"q": "9"}, None, '{"c9":"r3"}')],
        "task_id string, row_index int, category_name string, category_code string, attrs map<string,string>, missing array<string>, snapshot string")
    std = spark.createDataFrame([("10", 0, "k1"), ("10", 1, "k2")], "category_code string, pos int, target string")
    raw = spark.createDataFrame([("T", 0, 1, "c2", "S"), ("T", 0, 2, "c3", "U")], "task_id string, row_index int, pos int, name string, value string")
    out = external.rows_by_category(rows, std, raw).collect()
    sheet = lambda c: [(r.pos, r.key, r.row_index, r.value) for r in sorted(out, key=lambda r: (r.pos, r.row_index)) if r.category == c]
    assert [k for _, k, i, _ in sheet("A") if i == 0] == ["原始-c1", "原始-c2", "原始-c3", "k1", "k2", "z", "m", "a"]
    assert [v for _, _, i, v in sheet("A") if i == 0] == ["", "S", "U", "", "x", "1", "", ""]
    assert [v for _, _, i, v in sheet("A") if i == 1] == ["r1", "", "", "", "", "", "", "2"]
    assert sheet("20") == [] and [(k, v) for _, k, _, v in sheet("未分类")] == [("原始-c9", "r3"), ("q", "9")]
