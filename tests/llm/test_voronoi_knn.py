import random

import numpy as np

from partsmith.llm import voronoi_knn as V


def brute(vectors, every, k):
    out = []
    for q, a in vectors.items():
        if q % every:
            continue
        s = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), v) for v, b in vectors.items() if v != q)[:k]
        out += [(q, r, v, -s) for r, (s, v) in enumerate(s, 1)]
    return sorted(out)


def run(spark, vectors, every, k):
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, z array<double>")
    return sorted(tuple(r) for r in V.top_k(rows.filter(f"vec_id % {every} = 0"), rows, k).collect())


def clustered(n, seed, ties=False):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 60, (6, 8))
    out = {i: np.floor(centers[rng.integers(6)] + rng.normal(0, 3, 8)) for i in range(n)}
    if ties:
        for i in range(0, n, 3):
            out[i] = out[0]
    return out


def test_same_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "PIVOTS", 20)
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    monkeypatch.setattr(V, "ROW_BLOCK", 50)
    for seed, ties in ((1, False), (2, True)):
        vectors = clustered(240, seed, ties)
        assert run(spark, vectors, 5, 4) == brute(vectors, 5, 4)


def test_rows_and_queries_beyond_the_bounds_are_not_sent(spark, monkeypatch):
    """Rows of like norm in tight clusters: far fewer pairs meet than there are, and the result is whole."""
    monkeypatch.setattr(V, "QUERY_BLOCK", 12)
    monkeypatch.setattr(V, "ROW_BLOCK", 60)
    rng = np.random.default_rng(0)
    centers = np.eye(8) * 100
    vectors = {i: np.floor(centers[i % 8] + rng.normal(0, 1, 8)) for i in range(800)}
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, z array<double>")
    queries = df.filter("vec_id % 9 = 0")
    _, asked, sent = V.deal(queries, df, 5)
    rows = sent.groupBy("part", "block").count().withColumnRenamed("count", "n")
    met = asked.join(rows, ["part", "block"]).agg({"n": "sum"}).first()[0]
    blocks = sent.select("block").distinct().count()
    parts = asked.select("part").distinct().count()
    assert blocks > 8 and parts > 4
    assert met < 0.3 * 800 * queries.count()
    assert asked.count() < 0.5 * blocks * queries.count()
    assert sent.count() < 0.6 * parts * 800
    assert run(spark, vectors, 9, 5) == brute(vectors, 9, 5)


def test_few_rows_short_vectors_and_large_numbers(spark):
    few = {0: [1, 2], 1: [3], 2: [], 5: [-4, 0, 9]}
    assert run(spark, few, 5, 20) == brute({i: list(v) + [0] * (3 - len(v)) for i, v in few.items()}, 5, 20)
    large = {i: [2**40 + i, 1, -(2**20)] for i in range(12)}
    want = [(q, r, v, min(max(s, -(2**63)), 2**63 - 1)) for q, r, v, s in brute(large, 4, 3)]
    assert [x[3] for x in run(spark, large, 4, 3)] == [x[3] for x in want]
    assert run(spark, {7: [1.0]}, 1, 3) == []


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, -0.5]), (0, [0.5, -0.5]), (1, None), (2, [1.0, None]), (3, [inf, 0.0]), (4, [nan, 1.0]), (None, [1.0, 1.0]), (5, [0.011, -0.011]), (20, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as z", "1 as cell")
    got = {r.vec_id: r.z for r in V.floored(df, "vec_id", "embedding").collect()}
    assert got == {0: [32.0, -32.0], 5: [0.0, -1.0], 20: [128.0, 128.0]}
    assert V.floored(df.limit(0), "vec_id", "embedding").count() == 0
    empty = V.floored(df.limit(0), "vec_id", "embedding")
    assert V.top_k(empty, empty, 3).count() == 0


def test_pads_and_random(spark):
    rng = random.Random(1)
    vectors = {i: [rng.randint(-5, 5) for _ in range(3)] for i in range(90)}
    assert run(spark, vectors, 9, 20) == brute(vectors, 9, 20)
