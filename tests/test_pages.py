"""Deep pages: ranges are counted and cut, and only the rows of the last range are sorted."""

import datetime as dt
import functools
import random

import pytest

from partsmith.operators import order


def plain(rows, columns):
    """Rows in order, compared value by value; a null is less than everything."""
    def compare(a, b):
        for at, down in columns:
            x, y = a[at], b[at]
            if x != y:
                less = x is None or (y is not None and x < y)
                return (1 if less else -1) if down else (-1 if less else 1)
        return 0
    return sorted(rows, key=functools.cmp_to_key(compare))


@pytest.fixture()
def small_ranges(monkeypatch):
    monkeypatch.setattr(order, "NEAR", 40)
    monkeypatch.setattr(order, "CUTS", 4)
    monkeypatch.setattr(order, "SAMPLE", 64)


def made(n=3000):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    # a third of all rows share one value, a tenth have none
    name = lambda: rng.choice([None] + ["hot"] * 3 + [f"k{rng.randrange(400)}" for _ in range(6)])
    rows = [(i, name(), rng.choice([None, start + dt.timedelta(hours=rng.randrange(500))]), rng.choice([None, -0.5, 2.0, rng.random()]))
            for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("column", [1, 2, 3])
@pytest.mark.parametrize("down", [True, False])
def test_deep_pages_equal_the_sorted_list(spark, small_ranges, column, down):
    rows = made()
    names = ["id", "name", "at", "score"]
    frame = spark.createDataFrame(rows, "id long, name string, at timestamp, score double").repartition(6)
    whole = plain(rows, [(column, down), (0, False)])
    for offset, size in ((700, 25), (2990, 25)):
        got = [tuple(r) for r in order.page_of(frame, [(names[column], down), ("id", False)], offset, size).collect()]
        assert got == whole[offset:offset + size]


def test_ends_of_the_table(spark, small_ranges):
    frame = spark.range(500).withColumnRenamed("id", "k")
    assert order.page_of(frame, [("k", True)], 500, 10).count() == 0
    assert order.page_of(frame.limit(0), [("k", False)], 300, 10).count() == 0
    assert [r.k for r in order.page_of(frame, [("k", True)], 495, 10).collect()] == [4, 3, 2, 1, 0]


def test_rows_equal_in_all_columns_end_the_search(spark, small_ranges):
    frame = spark.range(900).selectExpr("cast(id < 100 as int) as k")
    got = [r.k for r in order.page_of(frame, [("k", True)], 90, 20).collect()]
    assert got == [1] * 10 + [0] * 10


def test_only_near_rows_are_sorted(spark, small_ranges):
    frame = spark.range(20000).withColumnRenamed("id", "k")
    page = order.page_of(frame, [("k", False)], 15000, 10)
    assert [r.k for r in page.collect()] == list(range(15000, 15010))
    # without the cuts the page's plan would skip 15,000 rows
    skipped = page._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset 15000" not in skipped and "Filter" in skipped
