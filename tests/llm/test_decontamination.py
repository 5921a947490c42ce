import random

import numpy as np
import pytest

from partsmith.llm import decontamination as D
from odd import no_docs, odd_docs, odd_rows


def words_of(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text or "").split()


def plain(item, words):
    """Best local alignment by the textbook table."""
    best, prev = 0, [0] * (len(words) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(words, 1):
            row.append(max(0, prev[j - 1] + (2 if a == b else -1), prev[j] - 1, row[j - 1] - 1))
        best, prev = max(best, *row), row
    return best


def test_alignment_equals_the_table():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert D.align(np.array(a), np.array(b))[0] == plain(a, b)


def made():
    rng = random.Random(12)
    vocab = [f"t{i}" for i in range(500)] + ["the", "of"] * 120
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, prose(rng.randint(14, 50))) for i in range(15)]
    docs, truth = [], set()
    for d in range(160):
        text = prose(rng.randint(10, 300))
        if d % 4 == 0:
            i, passage = rng.choice(items)
            passage = list(passage)
            for _ in range(rng.choice([0, 0, len(passage) // 10, len(passage) // 7])):
                at = rng.randrange(len(passage))
                rng.choice([lambda: passage.__setitem__(at, "edited"), lambda: passage.pop(at), lambda: passage.insert(at, "more")])()
            at = rng.randrange(len(text))
            text[at:at] = passage
            truth.add((d, i))
        docs.append((d, " ".join(w + rng.choice(["", "", ",", ".\n"]) for w in text)))
    return docs, items, truth


def test_planted_passages_and_scores(spark):
    docs, items, truth = made()
    frame = odd_docs(spark, [(d, t, "en", "a", 1) for d, t in docs])
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items] + [(99, None), (98, ""), (97, "t1")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.leaks(frame, bench).collect()}
    brute = {}
    for d, t in docs:
        w = words_of(t)
        for i, item in items:
            s = plain(item, w) / (2 * len(item))
            if s >= 0.5:
                brute[d, i] = s
    assert truth <= set(brute)
    assert {k: r.score for k, r in got.items()} == pytest.approx(brute)
    for (d, i), r in got.items():
        assert plain(dict(items)[i], words_of(dict(docs)[d])[r.first_word:r.last_word + 1]) == round(r.score * 2 * len(dict(items)[i]))
    left = D.decontaminate(frame, bench)
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def edited(rng, item, words):
    """``item`` with some words replaced, left out or put in, anywhere or between all words."""
    out = list(item)
    if rng.random() < 0.15:
        return [x for w in out for x in (w, rng.choice(words))][:-1]
    for _ in range(rng.randint(0, max(1, len(item) // 3))):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(at, rng.choice(words)), lambda: out.pop(at) if len(out) > 1 else None,
                    lambda: out.insert(at, rng.choice(words))])()
    return out


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_no_link_is_lost_on_short_items(spark, least):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(3000)] + ["the", "of", "a"] * 60
    items = [(i, [rng.choice(words) for _ in range(3 + i % 28)]) for i in range(140)]
    texts = []
    for d in range(420):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        at = rng.randint(0, len(text))
        text[at:at] = edited(rng, items[d % len(items)][1], words)
        texts.append(text)
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    number = {w: n for n, w in enumerate(sorted(set(words)))}
    coded = [np.array([number[w] for w in t]) for t in texts]
    want = {}
    for i, item in items:
        code = np.array([number[w] for w in item])
        for d, text in enumerate(coded):
            score = D.align(code, text)[0] / (2 * len(item))
            if score >= least:
                want[d, i] = score
    got = {(r.doc_id, r.item_id): r.score for r in D.leaks(docs, bench, least=least).collect()}
    assert len(want) > 150 and got == pytest.approx(want)


def test_a_pair_that_many_items_hold_is_no_seed(spark, monkeypatch):
    items = [(i, f"the end {' '.join(f'i{i}x{k}' for k in range(10))}") for i in range(1000)]
    docs = spark.createDataFrame([(d, "the end " * 20 + f"n{d}") for d in range(200)] + [(1000, items[7][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    staged, keep = {}, D.stage
    monkeypatch.setattr(D, "stage", lambda df, label: staged.setdefault(label, keep(df, label)))
    near = []
    whole = D._places
    monkeypatch.setattr(D, "_places", lambda hits, seeds: near.append(seeds) or whole(hits, seeds))
    assert [(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()] == [(1000, 7)]
    assert staged["seeds"].count() > 200 * 20
    assert staged["seeds"].join(near[0], "gram").count() < 100


def test_odd_rows_and_empty_tables(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, "No id, but WORDS!"), (1, "one"), (None, "quick brown fox jumps over the lazy dog"), (5, None)],
                                  "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, round(r.score, 2)) for r in D.leaks(docs, bench).collect())
    assert got == [(0, 1, 1.0), (1, 0, 1.0), (2, 0, 1.0), (9, 1, 1.0), (10, 1, 1.0)]
    assert D.decontaminate(docs, bench).count() == len(odd_rows()) - 6
    assert D.leaks(no_docs(spark), bench).count() == 0 and D.decontaminate(no_docs(spark), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.decontaminate(docs, bench.limit(0)).count() == len(odd_rows())


def test_given_documents(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    given, items = docs.collect(), [(r.item_id, words_of(r.text)) for r in bench.collect()]
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}
    exact = {(r.doc_id, i) for r in given for i, w in items if " ".join(w) in " ".join(words_of(r.text))}
    assert exact and exact <= got
    near = {(r.doc_id, i) for r in given for i, w in items if len(r.text) < 4000 and D.align(
        np.array([hash(x) for x in w]), np.array([hash(x) for x in words_of(r.text)]))[0] >= len(w)}
    assert {k for k in got if len(next(r.text for r in given if r.doc_id == k[0])) < 4000} == near
