import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from partsmith.llm import pitman_yor as H
from odd import no_docs, odd_docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def base(rows):
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in rows:
        ws = tokens(t)
        out.append((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r[:5])


def same(got, exp):
    got = sorted((tuple(r)[:6] for r in got), key=key)
    exp = sorted(exp, key=key)
    assert [g[:5] for g in got] == [e[:5] for e in exp]
    assert sorted(g[5] for g in got) == pytest.approx(sorted(e[5] for e in exp), rel=1e-9)


def test_base_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 500")
    got = H.score(docs, H.fit(docs)).collect()
    same(got, base([(r.doc_id, r.text) for r in docs.collect()]))
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_held_out_perplexity(spark):
    """Words whose last letter says what may follow: the contexts must beat single words, on texts that were not learnt from."""
    rng = random.Random(6)
    stems = ["".join(rng.choice("bcdfghklm") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    after = {c: rng.sample(stems, 30) for c in "aeiou"}
    rows = []
    for i in range(400):
        w = [rng.choice(stems)]
        for _ in range(rng.randint(10, 60)):
            w.append(rng.choice(after[w[-1][-1]]))
        rows.append((i, " ".join(w), "en", "a", 1))
    docs = odd_docs(spark, rows).drop("score")
    scores = H.score(docs, H.fit(docs))
    out = [r for r in scores.collect() if r.held_out]
    gain = sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)
    assert len(out) > 20 and gain > 0.2
    found = {r.held_out: r.perplexity for r in H.perplexity(scores).collect()}
    assert 15 < found[False] < found[True] < 80


def test_small_chunks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(H, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(H, "FLUSH_ROWS", 5)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = {r.doc_id: r.score for r in H.score(docs, H.fit(docs)).collect()}
    monkeypatch.setattr(H, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(H, "MERGE_PAIRS", 50)
    fitted = H.fit(docs)
    assert len(fitted.layout.hot) > 10 and fitted.layout.bits > 4
    got = H.score(docs, fitted).collect()
    same(got, base([(r.doc_id, r.text) for r in docs.collect()]))
    # seats are drawn anew, so scores differ by chance only
    assert sum(r.score for r in got) == pytest.approx(sum(whole.values()), rel=0.01)


def test_better_than_single_words_on_given_documents(spark):
    """Held-out documents of the given tables: the words before must be worth a factor of two in perplexity."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = H.score(docs, H.fit(docs)).filter("held_out").groupBy().sum("score", "base_score", "n_tokens").first()
    assert 10 ** ((out[1] - out[0]) / out[2]) < 0.5


def test_odd_rows(spark):
    same(H.score(odd_docs(spark), H.fit(odd_docs(spark))).collect(), base([(r[0], r[1]) for r in odd_rows()]))
    assert H.score(no_docs(spark), H.fit(no_docs(spark))).count() == 0
    alone = next(i for i in range(100) if held(i))
    only = odd_docs(spark, [(alone, "never seen", "en", "a", 1)])
    r = H.score(only, H.fit(only)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    words = pa.array([b"ab", b"abc", b"b", b"\xff"], pa.large_binary())
    key = H.triples(words, np.array([2, 3, 1, 1]))
    keys, counts = np.unique(key, return_counts=True)
    s = H.sample_spelling(keys, counts * 3, None, rng)
    dense = s.left2[:, None] * s.double[np.arange(65536) % 256]
    dense.ravel()[s.keys] += s.triple
    assert dense.sum(axis=1) == pytest.approx(np.ones(65536))
    # by hand: a, b, stop after the beginning
    p = 1.0
    for pair, third in ((0, 97), (97, 98), (97 * 256 + 98, 256)):
        p *= dense[pair, third]
    assert s.words(pa.array([b"ab"], pa.binary()))[0] == pytest.approx(p)


def test_seating_has_the_right_number_of_tables():
    """Expected tables of a dish with fixed odds, by the recursion over customers one at a time."""
    rng = random.Random(1)
    for c, a, d in ((1, 0.5, 0.3), (2, 0.5, 0.3), (12, 2.0, 0.6), (30, 0.1, 0.8)):
        p = {1: 1.0}
        for n in range(1, c):
            q = Counter()
            for k, x in p.items():
                new = a / (a + n - d * k)
                q[k + 1] += x * new
                q[k] += x * (1 - new)
            p = q
        want = sum(k * x for k, x in p.items())
        got = H.seat(np.full(40_000, c), np.full(40_000, a), d, np.random.default_rng(rng.randrange(99))).mean()
        assert got == pytest.approx(want, rel=0.03)
    large = H.seat(np.array([10**7]), np.array([5.0]), 0.5, np.random.default_rng(0))
    assert 1 <= large[0] <= 10**7


def test_predictive_of_a_context_sums_to_one(spark):
    docs = odd_docs(spark, [(1, "aa bb aa bb cc aa", "en", "a", 1), (2, "aa aa dd", "en", "a", 1), (3, "bb cc", "en", "a", 1)])
    fitted = H.fit(docs)
    rows = spark.read.parquet(fitted.path).toArrow().combine_chunks().to_batches()
    (_, b), = [x for batch in rows for x in H.read_buckets(batch)]
    left = np.stack([s.left() for s in fitted.samples], axis=1)
    own = np.column_stack([s.own(b.contexts, b.counts, b.seen[:, i]) for i, s in enumerate(fitted.samples)])
    spelled = [1 - sum(s.spelling.words(b.words)) for s in fitted.samples]  # the rest is the mass of spellings that do not occur
    assert len(set(b.contexts)) == 5 and len(b.keys) == 5
    for context in set(b.contexts):
        seen = own[b.contexts == context].sum(axis=0) + left[context] * b.roots.sum(axis=0)
        unseen = [left[context, i] * s.root(0, 0, spelled[i]) for i, s in enumerate(fitted.samples)]
        assert (seen + unseen).mean() == pytest.approx(1, abs=1e-6)


def test_long_unseen_words_have_finite_scores(spark):
    """Spellings whose probability is below any double: a random word of 2,000 bytes, and a text without spaces."""
    rng = random.Random(14)
    learnt = [(i, " ".join(rng.choice(["some", "words", "to", "learn", "from"]) for _ in range(30)), "en", "a", 1) for i in range(100, 140)]
    one, two, three = [i for i in range(100) if held(i)][:3]
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(2000))
    signs = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(5000))
    docs = odd_docs(spark, [*learnt, (one, f"some {key} words", "en", "a", 1), (two, signs, "zh", "a", 1), (three, "some words", "en", "a", 1)]).drop("score")
    scores = H.score(docs, H.fit(docs))
    found = {r.doc_id: r for r in scores.collect()}
    assert all(math.isfinite(r.score) and r.score < 0 for r in found.values())
    assert -4 * 2000 < found[one].score - found[three].score < -2000 and found[two].score < -5000
    s = H.Spelling(np.zeros(0, np.int64), np.zeros(0), np.ones(65536), np.full((256, 257), 1 / 257))
    assert s.log_words(pa.array([b"a" * 999, b"b"], pa.binary())) == pytest.approx([-1000 * math.log(257), -2 * math.log(257)])
