import zlib
from collections import defaultdict

from partsmith.llm import kd_shards
from odd import no_docs, odd_docs, odd_rows


def check_places(rows, n_shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(0 <= s < n_shards for s in by)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sizes_near_equal_and_places_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = kd_shards.shard(docs, 10).collect()
    given = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(given)
    check_places(rows, 10)
    for r in rows:
        raw = (given[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "bytes")
    sums = defaultdict(int)
    for r in rows:
        sums[r.shard] += r.size
    mean, longest = sum(sums.values()) / 10, max(r.size for r in rows)
    assert max(sums.values()) - mean <= 2 * longest and mean - min(sums.values()) <= 2 * longest


def brute(rows, dims, first, shards, out):
    if shards == 1 or not rows:
        for r in rows:
            out[r["_row"]] = first
        return
    width = lambda i: max(r[f"_k{i}"] >> 31 for r in rows) - min(r[f"_k{i}"] >> 31 for r in rows)
    dim = max(range(dims), key=lambda i: (width(i), -i))
    half, total, below = shards // 2, sum(r["size"] for r in rows), 0
    goal, rows = total * half / shards, sorted(rows, key=lambda r: r[f"_k{dim}"])
    for at, r in enumerate(rows):  # noqa: B007
        if below + r["size"] >= goal:
            break
        below += r["size"]
    if below + r["size"] - goal <= goal - below:
        at += 1
    brute(rows[:at], dims, first, half, out)
    brute(rows[at:], dims, first + half, shards - half, out)


def test_same_cuts_as_sorting_each_node(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    meta = kd_shards.metadata(docs).cache()
    tree = kd_shards.build_tree(meta, 7)
    got = {r["_row"]: r["s"] for r in meta.select("_row", tree.place().alias("s")).collect()}
    want = {}
    brute([r.asDict() for r in meta.collect()], 3, 0, 7, want)
    assert got == want


def test_hot_value_is_cut(spark):
    rows = [(i, "x" * 84, "en", "hot", 84) for i in range(800)]
    sums = defaultdict(int)
    for r in kd_shards.shard(odd_docs(spark, rows), 8, ("source", "lang")).collect():
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) <= 300


def test_odd_rows(spark):
    got = kd_shards.shard(odd_docs(spark), 5)
    rows = got.collect()
    assert len(rows) == len(odd_rows())
    check_places(rows, 5)
    assert kd_shards.shard(no_docs(spark), 5).count() == 0
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
