import random
import re

import numpy as np

from partsmith.llm import minhash
from partsmith.llm.components import components
from odd import no_docs, odd_docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent=80):
    """rows: (doc_id, text); component of each by all pairs."""
    sets, parent = [sets_of(t, width) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def made(n_groups=25, seed=4):
    rng, out = random.Random(seed), []
    vocab = [f"w{i}" for i in range(4000)]
    common = [rng.choice(vocab) for _ in range(120)]
    for _ in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 200))]
        out.append(base)
        for _ in range(rng.randint(0, 14)):  # edits around the threshold
            copy = list(rng.choice(out[-4:]))
            for _ in range(rng.randint(0, max(1, len(copy) // 9))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(copy)
    out += [common + [rng.choice(vocab) for _ in range(rng.randint(5, 60))] for _ in range(60)]
    rng.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def frame(spark, rows):
    return odd_docs(spark, [(d, t, "en", "a", 1) for d, t in rows])


def test_same_components_as_all_pairs(spark):
    rows = made()
    for width in (2, 5):
        got = minhash.near_duplicates(frame(spark, rows), width).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, width))
        assert all(r.kept == (r.doc_id == r.component_id) and r.copy != r.kept for r in got)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = minhash.near_duplicates(docs, 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 2))
    kept = minhash.deduplicate(docs, 2)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "PER_CENTER", 2)
    rows = made(12, 9)
    got = minhash.near_duplicates(frame(spark, rows), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 2))


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = minhash.near_duplicates(odd_docs(spark), 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, 2), key=key)
    assert sum(not r.copy for r in got) == len({(r.component_id, r.n_shingles and r.component_id, r.n_shingles) for r in got})
    docs = odd_docs(spark)
    kept = minhash.deduplicate(docs, 2)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [-4, 0, 0, 1, 3, 4, 5, 6, 7, 8, 9, 100]
    assert minhash.near_duplicates(no_docs(spark), 2).count() == 0 and minhash.deduplicate(no_docs(spark), 5).count() == 0


def test_posterior_bounds():
    for n, m in zip(range(minhash.BATCH, minhash.HASHES + 1, minhash.BATCH), minhash.least_matches(80)):
        assert 0.3 * n < m < 0.8 * n
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**8, (2000, minhash.HASHES)).astype(np.uint8)
    other = np.where(rng.random(base.shape) < 0.8, base, rng.integers(0, 2**8, base.shape)).astype(np.uint8)
    assert len(minhash._survive(base, other, 80)) == 2000
    assert len(minhash._survive(base, rng.permutation(base), 80)) < 20


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 3), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    group = {}
    for u, v in links:
        if u is not None and u != v:
            a, b = group.setdefault(u, {u}), group.setdefault(v, {v})
            if a is not b:
                a |= b
                for x in b:
                    group[x] = a
    assert got == {x: min(g) for x, g in group.items()}
