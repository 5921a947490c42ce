import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from partsmith.llm import toxicity
from partsmith.llm.words import MARKS, Words
from odd import no_docs, odd_docs, odd_rows


def made(spark, n=1200):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["Nasty,", "nasty", "VILE!!", "foul creature"]))
        docs.append((i, " ".join(text), "en", "a", 1))
        labels.append((i, 1, toxic))
    return odd_docs(spark, docs).drop("toxic"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_held_out_accuracy(spark):
    docs, labels, truth = made(spark)
    model = toxicity.fit(toxicity.labelled_rows(docs, labels))
    rows = toxicity.score(docs.withColumn("held_out", toxicity.held_out()), model).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.toxic_score <= 1 and r.toxic_predicted == (r.toxic_score >= 0.3) and r.score == "extra"
    held = [r for r in rows if r.held_out]
    assert np.mean([r.toxic_predicted == truth[r.doc_id] for r in held]) > 0.97
    assert len(model.index) < 2000


def plain_features(text):
    w = "".join(c.lower() if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text).split()
    return {("w", x) for x in w} | {(g, *x) for g in (1, 2) for x in zip(w, w[g:])}


def test_features_are_presences_within_a_row():
    texts = ["a b a b", "", None, "b a", "Word, WORD! wörd"]
    batch = pa.RecordBatch.from_pydict({"toxic": pa.array([0] * 5, pa.int32()), "text": pa.array(texts)})
    out = next(toxicity._extract([batch]))
    assert [len(np.frombuffer(c, "<i4")) for c in out.column(1).to_pylist()] == [len(plain_features(t or "")) for t in texts]


def test_ftrl_equals_a_plain_loop():
    rng, rates = np.random.default_rng(3), toxicity.Rates(l1=0.5, passes=2)
    examples = [(int(rng.random() < 0.4), np.unique(rng.integers(0, 12, 5)).astype(np.int32)) for _ in range(60)]
    z, n = {}, {}
    pos = sum(y for y, _ in examples)
    bias, bias_n = np.log((pos + 1) / (len(examples) - pos + 19)), 1.0
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= rates.l1 else (np.sign(z[i]) * rates.l1 - z[i]) / ((rates.beta + n[i] ** 0.5) / rates.alpha + rates.l2)
    for _ in range(rates.passes):
        for y, at in examples:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - y
            for i in at:
                old = n.get(i, 0)
                n[i] = old + g * g
                z[i] = z.get(i, 0) + g - (n[i] ** 0.5 - old ** 0.5) / rates.alpha * w[i]
            bias_n += g * g
            bias -= 0.5 * g / bias_n ** 0.5
    model = toxicity.ftrl(examples, rates)
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx({i: weight(i) for i in z if weight(i)}, rel=1e-3)
    assert model.bias == pytest.approx(bias, rel=1e-4)


def test_odd_rows_and_empty_tables(spark):
    docs, labels, _ = made(spark, 100)
    odd = odd_docs(spark).drop("toxic")
    none = spark.createDataFrame([(None, 1, 1), (9, 1, None), (9, 1, 1), (9, 1, 0), (12345, 0, 1)], "doc_id long, quality int, toxic int")
    assert [(r.key, r.toxic) for r in toxicity.labelled_rows(odd, none).collect()] == ([] if zlib.crc32(b"9") % 4 == 2 else [(9, 1)])
    for lab in (labels, none, labels.limit(0)):
        model = toxicity.fit(toxicity.labelled_rows(odd, lab))
        rows = toxicity.score(odd, model).collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r.toxic_score <= 1 for r in rows)
    assert toxicity.score(no_docs(spark), model).count() == 0
    assert toxicity.fit(toxicity.labelled_rows(no_docs(spark).drop("toxic"), labels)).index.size == 0


def test_long_and_short_words():
    texts = pa.array(["a" * 9000 + " b", "ab", "a b", "", None, " x "])
    w = Words(texts, MARKS)
    assert np.diff(w.row_at).tolist() == [2, 1, 2, 0, 0, 1]
    assert len(set(w.hash.tolist())) == 5
