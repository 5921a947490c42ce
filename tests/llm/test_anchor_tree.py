import numpy as np
import pytest
from pyspark.sql import functions as F

from partsmith.llm import anchor_tree as A

OUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def dot(a, b):
    return sum(int(x) * int(y) for x, y in zip(a, b))


def brute(rows, every, n_pos, n_neg, least, most):
    out = []
    for a, la, za in {(v, lab, tuple(z)) for v, lab, z in rows if v % every == 0}:
        scored = sorted((-dot(za, z), v, lab) for v, lab, z in rows if v != a)
        for s, p, _ in [x for x in scored if x[2] == la][:n_pos]:
            fits = [(n, -t) for t, n, lab in scored if lab != la and least * -s <= 100 * -t <= most * -s][:n_neg]
            out += [(a, p, r, n, -s, t) for r, (n, t) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, every, n_pos, n_neg, least=30, most=90):
    df = spark.createDataFrame([(v, lab, [float(x) for x in z]) for v, lab, z in rows], "vec_id long, label int, embedding array<double>")
    df = df.withColumns({c: F.lit("x") for c in ("z", "part", "block", "score", "place", "rank")})
    return sorted(tuple(r[c] for c in OUT) for r in A.mine(A.whole_rows(df, 1), every, n_pos, n_neg, least, most).collect())


def made(n, width, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 50, (6, width))
    group = rng.integers(6, size=n)
    return [(i, int(g if rng.random() < 0.7 else rng.integers(6)), np.floor(centers[g] + rng.normal(0, 20, width)).tolist()) for i, g in enumerate(group)]


@pytest.mark.parametrize("anchors, rows", [(512, 8192), (7, 40)])
def test_same_as_all_pairs(spark, monkeypatch, anchors, rows):
    monkeypatch.setattr(A, "ANCHOR_BLOCK", anchors)
    monkeypatch.setattr(A, "ROW_BLOCK", rows)
    data = made(260, 5, 1)
    want = brute(data, 6, 5, 10, 30, 90)
    assert run(spark, data, 6, 5, 10) == want and len(want) > 500


def test_ties_repeated_rows_and_negative_scores(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(rng.integers(3)), rng.integers(-2, 3, 2).tolist()) for i in range(60)]
    data += [data[7]] * 3 + [data[10]] * 2 + [(10, 1, [9, 9]), (20, 0, [0, 0])] + [(200 + i, 2, [1, 1]) for i in range(40)]
    assert run(spark, data, 10, 3, 4, 0, 100) == brute(data, 10, 3, 4, 0, 100)


def test_spanning_tree_is_minimal():
    points = np.random.default_rng(2).normal(size=(9, 3))
    tree = A.spanning_tree(points)
    assert len(tree) == 9 and {v for v, _, _ in tree} == set(range(9))
    seen = set()
    for v, p, edge in tree:
        assert p in seen or v == p
        assert edge == pytest.approx(np.linalg.norm(points[v] - points[p]))
        seen.add(v)
    edges = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(9) for j in range(i))
    root, total = list(range(9)), 0.0
    for w, i, j in edges:
        if root[i] != root[j]:
            total += w
            root = [root[i] if r == root[j] else r for r in root]
    assert sum(e for _, _, e in tree) == pytest.approx(total)


def test_bounds_hold_and_spare_rows():
    """Anchors that lie close together share what is known about the rows."""
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 100, (8, 16))
    z = np.floor(np.concatenate([c + rng.normal(0, 2, (300, 16)) for c in centers]))
    labels, ids = np.repeat(np.arange(8) % 4, 300), np.arange(len(z))
    anchors = z[:300:10]
    block = A.Block(z)
    for node, low, high in block.walk(anchors):
        true = z @ anchors[node]
        assert (low <= true).all() and (true <= high).all()
    block = A.Block(z)
    own = np.zeros(30, np.int64)
    best = {n: s.tolist() for n, _, s in A.best_of_label(anchors, ids, labels, block, ids[:300:10], own, 5)}
    for n, scores in best.items():
        mine = (labels == 0) & (ids != n * 10)
        assert scores == np.sort(z[mine] @ anchors[n])[::-1][:5].astype(int).tolist()
    list(A.in_windows(anchors, ids, labels, block, ids[:300:10], own, list(best.values()), 10, 30, 90))
    assert block.scored < 0.35 * 2 * len(anchors) * len(z)


def test_large_numbers(spark):
    data = [(i, i % 2, [2**22 - i, 2**22, -(2**21) + 3 * i, 7]) for i in range(30)]
    assert run(spark, data, 5, 2, 3, 30, 100) == brute(data, 5, 2, 3, 30, 100)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.5, 1.0]), (1, 1, [2.0]), (2, 2, [1.0, 0.0, 5.0]), (3, 2, []), (4, None, [1.0]), (5, 1, None), (6, 1, [None, 1.0]), (7, 2, [inf]), (8, 2, [nan]), (None, 1, [1.0]), (9, 2, [1e30])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "'x' as z", "1 as part", "2 as print")
    kept = A.whole_rows(df, 1)
    assert {r.vec_id: r.z for r in kept.collect()} == {0: [1, 1], 1: [2], 2: [1, 0, 5], 3: [], 9: [2**22]}
    got = [tuple(r[c] for c in OUT) for r in A.mine(kept, 100, 5, 10, 30, 90).collect()]
    assert got == [(0, 1, 1, 2, 2, 1)]
    assert A.mine(kept.limit(0), 100, 5, 10, 30, 90).count() == 0
    assert A.mine(kept.filter("vec_id = 0"), 100, 5, 10, 30, 90).count() == 0
    assert A.mine(kept.filter("vec_id > 0"), 100, 5, 10, 30, 90).count() == 0
