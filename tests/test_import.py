"""CSV files read in ranges: records, numbers and states at their ends."""

import csv
import io
import random

import pytest

from partsmith.sources import csv_ranges as R
from partsmith.sources import files


@pytest.mark.parametrize("line, quoted, ends", [
    ('a,b', False, False), ('a,"b', False, True), ('a,"b"', False, False), ('5" pipe,x', False, False), ('"a""', False, True), ('"a"",b', False, True),
    ('"a""",b', False, False), ('x,', True, True), ('x",y', True, False), ('x","y', True, True), ('', True, True), ('""', True, True), ('"', True, False),
    ('"a"b"c,d', False, False), ('a, "b', False, False), ('","', False, False)])
def test_state_at_the_end_of_a_line(line, quoted, ends):
    assert R.ends_quoted(line, quoted) is ends


def test_ends_agree_with_a_csv_reader():
    rng = random.Random(1)
    for _ in range(300):
        cells = [["".join(rng.choice('ab",\n ') for _ in range(rng.randrange(6))) for _ in range(3)] for _ in range(4)]
        text = "\n".join(",".join('"' + c.replace('"', '""') + '"' if rng.random() < 0.5 or set(c) & set('",\n') else c for c in row) for row in cells)
        quoted, found = False, 0
        for line in text.split("\n"):
            found += not quoted and line != ""
            quoted = R.ends_quoted(line, quoted)
        assert not quoted and found == sum(1 for row in csv.reader(io.StringIO(text, newline="")) if row)


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def made(rng, n):
    def cell(i):
        kind = rng.randrange(8)
        return ["plain", f"v{i}", 'say "hi"', "a,b", "first\nsecond\n\nfourth", '5" pipe', "x" * 40, "\n".join(f"line {j}" for j in range(40))][kind if kind < 7 or rng.random() < 0.3 else 0]

    return [[str(i), cell(i), cell(i + 1)] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_of_many_ranges(spark, tmp_path, small_ranges, end):
    rows = made(random.Random(7), 400)
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["编码", "名称\n(two lines)", "x"])
        for i, row in enumerate(rows):
            out.writerow(row)
            if i % 50 == 3:
                f.write(end)  # an empty line is no record
    path = str(tmp_path / "a.csv")
    assert R._lines(spark, path).select("range").distinct().count() > 10
    found = {r.record: r.text for r in R.records(spark, path).collect()}
    assert sorted(found) == list(range(401))
    assert [next(csv.reader([found[i + 1]] if "\n" not in found[i + 1] else found[i + 1].splitlines(True))) for i in range(400)] == rows
    got = files.read_csv(spark, path, 3)
    cells = [[r.col1, r.col2, r.col3] for r in got.rows.orderBy("row_id").collect()]
    assert cells == rows and got.counts.first().total_rows == 400
    assert [r.row_index for r in got.rows.orderBy("row_id").collect()] == list(range(2, 402))


def test_sheet_of_several_files_and_an_unclosed_quote(spark, tmp_path, small_ranges):
    folder = tmp_path / "sheet"
    folder.mkdir()
    for part, lines in (("part-0.csv", ["a,b"] + [f"{i},x{i}" for i in range(70)]), ("part-1.csv", ["a,b"]), ("part-2.csv", ["a,b"] + [f"{i},x{i}" for i in range(70, 100)])):
        (folder / part).write_text("\n".join(lines), encoding="utf-8")
    got = files.read_csv(spark, str(folder), 1).rows.orderBy("row_id").collect()
    assert [(r.col1, r.col2, r.row_index) for r in got] == [(str(i), f"x{i}", i + 2) for i in range(100)]
    (tmp_path / "open.csv").write_text("a,b\n1,ok\n2,\"never closed\n" + "3,x\n" * 300, encoding="utf-8")
    got = files.read_csv(spark, str(tmp_path / "open.csv"), 1).rows.orderBy("row_id").collect()
    assert [r.col1 for r in got] == ["1", "2"] and got[1].col2.startswith("never closed\n3,x")


def test_no_header(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("", encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "empty.csv"), 1)
