"""The dashboard of files with odd rows: unknown files, rows of no file, more categories than are shown, a status of its own."""

import pytest

from partsmith.operators import reports


@pytest.fixture(scope="module")
def board(spark):
    titles = spark.createDataFrame([(1, "a.csv", 40), (2, "b.csv", 3), (3, "empty.csv", 0)], "title_id long, file_name string, total_rows long")
    # file 1: category k has k rows, two rows have none; file 9 is in no list of files, two rows name no file
    rows = [(1, k, f"c{k:02d}", "approved", "NAME_EXACT", 70.0) for k in range(1, 13) for _ in range(k)]
    rows += [(1, None, None, "needs_review", "UNMATCHED", 20.0)] * 2 + [(2, 1, "c01", "held", "NAME_EXACT", None)] * 3
    rows += [(9, 12, "c12", "export_ready", "FUZZY_AMBIGUOUS", 90.0)] * 4 + [(None, 1, "c01", "approved", "NAME_EXACT", 70.0)] * 2
    cleaned = spark.createDataFrame(
        [(i, i % 2, *r) for i, r in enumerate(rows)],
        "row_id long, is_duplicate int, title_id long, category_id long, category_code string, status string, match_source string, quality_score double")
    taxonomy = spark.createDataFrame([(k, f"name {k}") for k in range(1, 12)], "id long, category_name string")
    raw = cleaned.select("row_id", "title_id").where("row_id <> 5")
    results = cleaned.where("category_id > 6").select("title_id", "row_id")
    failed = cleaned.where("category_id <= 6").select("row_id")
    samples = cleaned.where("match_source <> 'NAME_EXACT' or row_id = 5").selectExpr("row_id AS entity_id")
    out = reports.dashboard(titles, raw, cleaned, results, failed, samples, taxonomy)
    return {(r.scope, r.title_id): r for r in out.collect()}


def test_a_row_per_file_and_one_for_all(board):
    assert set(board) == {("file", 1), ("file", 2), ("file", 3), ("all", None)}
    assert [board["file", i].file_name for i in (1, 2, 3)] == ["a.csv", "b.csv", "empty.csv"] and board["all", None].file_name is None
    none = board["file", 3]
    assert (none.files, none.cleaned, none.matched, none.avg_score, none.status_distribution, none.category_distribution) == (1, 0, 0, None, [], [])


def test_all_holds_the_rows_of_unknown_files(board):
    one, every = board["file", 1], board["all", None]
    assert (one.files, one.total_rows, one.cleaned, one.unmatched, one.matched, one.filled, one.failed, one.low_confidence) == (1, 40, 80, 2, 78, 57, 20, 2)
    assert (every.files, every.total_rows, every.cleaned, every.unmatched, every.matched) == (3, 43, 89, 2, 87)
    assert (every.filled, every.failed, every.low_confidence, every.duplicates) == (61, 26, 7, 44)
    assert every.avg_score == 69.8  # (78 * 70 + 2 * 20 + 4 * 90 + 2 * 70) / 86


def test_every_status_is_listed(board):
    assert [tuple(e) for e in board["all", None].status_distribution] == [("approved", 80), ("export_ready", 4), ("held", 3), ("needs_review", 2)]
    assert [tuple(e) for e in board["file", 2].status_distribution] == [("held", 3)]


def test_ten_categories_with_names(board):
    one = [tuple(e) for e in board["file", 1].category_distribution]
    assert one == [(12, "c12", None, 12), *[(k, f"c{k:02d}", f"name {k}", k) for k in range(11, 2, -1)]]
    every = [tuple(e) for e in board["all", None].category_distribution]
    assert every == [(12, "c12", None, 16), *[(k, f"c{k:02d}", f"name {k}", k) for k in range(11, 6, -1)],
                     (1, "c01", "name 1", 6), (6, "c06", "name 6", 6), (5, "c05", "name 5", 5), (4, "c04", "name 4", 4)]


def test_pairs_repeat_the_counts(board):
    one = board["file", 1]
    assert [e.value for e in one.match_distribution] == [one.matched, one.unmatched] and [e.value for e in one.fill_distribution] == [one.filled, one.failed]
