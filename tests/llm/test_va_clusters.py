import hashlib

import numpy as np
import pyarrow as pa

from partsmith.llm import va_clusters as V


def brute(vectors, k, rounds, seed=1):
    """vectors: list of (vec_id, numbers)."""
    start = sorted(vectors, key=lambda v: (hashlib.sha256(f"{seed}:{v[0]}".encode()).hexdigest(), v[1]))[:k]
    centroids = [list(z) for _, z in start]

    def nearest(z):
        return min((sum((a - b) ** 2 for a, b in zip(z, c)), i) for i, c in enumerate(centroids))[::-1]

    for _ in range(rounds):
        placed = [nearest(z)[0] for _, z in vectors]
        for c in range(len(centroids)):
            mine = [z for (_, z), p in zip(vectors, placed) if p == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(v, *nearest(z)) for v, z in vectors]
    per = {}
    for _, c, d in out:
        per[c] = per.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((v, c, d, per[c], sum(per.values()), sha[c]) for v, c, d in out)


def run(spark, vectors, width, k, rounds):
    rows = spark.createDataFrame([(v, [float(x) for x in z], "extra") for v, z in vectors], "vec_id long, embedding array<float>, cluster string")
    out = V.cluster(V.whole_numbers(rows, "vec_id", "embedding", width, 1), width, k, rounds)
    return sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())


def made(n, width, seed, spread):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-100, 100, (5, width))
    return [(i, [int(x) for x in centers[rng.integers(5)] + rng.integers(-spread, spread + 1, width)]) for i in range(n)]


def test_same_as_plain_rounds(spark):
    vectors = made(300, 6, 1, 40)
    assert run(spark, vectors, 6, 7, 3) == brute(vectors, 7, 3)


def test_ties_repeated_rows_and_empty_clusters(spark):
    vectors = [(i % 9, [i % 3, 0]) for i in range(60)] + [(50, [1, 0])] * 2500 + [(51, [0, 0])] * 3
    assert run(spark, vectors, 2, 16, 2) == brute(vectors, 16, 2)


def test_few_vectors_and_no_rounds(spark):
    vectors = [(3, [5, -5]), (1, [0, 0])]
    assert run(spark, vectors, 2, 16, 3) == brute(vectors, 16, 3)
    assert run(spark, made(40, 3, 5, 9), 3, 4, 0) == brute(made(40, 3, 5, 9), 4, 0)


def test_intervals_hold_the_distances_and_settle_most():
    rng = np.random.default_rng(4)
    centers = rng.integers(-200, 200, (8, 16))
    z = centers[rng.integers(8, size=4000)] + rng.integers(-20, 21, (4000, 16))
    cells = V.Cells(z[:500], z.min(axis=0), z.max(axis=0))
    code = cells.code(z)
    assert (cells.unpack(pa.array(cells.pack(code)), 16) == code).all() and code.max() < 2**V.BITS
    low, high = V.intervals(code, *cells.tables(centers))
    far = ((z[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (low <= far).all() and (far <= high).all()
    open_ = low <= high.min(axis=1, keepdims=True)
    assert open_[np.arange(4000), far.argmin(axis=1)].all()
    assert (open_.sum(axis=1) > 1).mean() < 0.05


def test_only_vectors_with_overlapping_intervals_are_fetched(spark, monkeypatch):
    vectors = made(400, 8, 2, 5)
    fetched = []
    assign = V.stage

    def stage(df, label):
        out = assign(df, label)
        if label == "va_bounds":
            fetched.append(out.filter("near IS NULL").count())
        return out

    monkeypatch.setattr(V, "stage", stage)
    assert run(spark, vectors, 8, 5, 2) == brute(vectors, 5, 2)
    assert len(fetched) == 3 and fetched[-1] < 200


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, -0.5]), (1, None), (2, [1.0, None]), (3, [inf, 0.0]), (4, [nan, 1.0]), (None, [1.0, 1.0]), (5, [0.011, -0.011]), (6, [1.0]), (7, []), (8, [1e30, -1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as z", "1 as cluster", "2 as print")
    kept = V.whole_numbers(df, "vec_id", "embedding", 2, 64)
    assert {r.vec_id: r.z for r in kept.collect()} == {0: [32, -32], 5: [0, -1], 8: [2**26, -(2**26)]}
    out = V.cluster(kept, 2, 16, 3).collect()
    assert len(out) == 3 and {r.inertia for r in out} == {0}
    assert V.cluster(kept.limit(0), 2, 16, 3).count() == 0
