import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa

from partsmith.llm import secrets_crf as S
from odd import no_docs, odd_docs, odd_rows

PLAIN = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def want(text):
    out = []
    for at, (kind, rx, group, least) in enumerate(PLAIN):
        out += [(m.start(group), at, f"{kind}:{m.start(group)}:{m.end(group)}") for m in rx.finditer(text or "") if m.end(group) - m.start(group) >= least]
    return [s for *_, s in sorted(out)]


def shown(spans):
    return [f"{k}:{a}:{b}" for a, k, b in spans]


def test_base_spans():
    rng = random.Random(7)
    parts = ["password", "PASSWD", "ApiKey", "api_key", "toKen", "secret", "=", ":", " ", '"', "'", "AKIA", "AKIAB2", "0123456789abcdef", "Zz9+/_.=-", "é", "x", "\n",
             "abcdefghijklmnop", "K", "ſecret", "F00D", "q" * 5]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert shown(S.base_spans(text)) == want(text), text


def test_viterbi_and_cuts_equal_all_paths():
    rng = np.random.default_rng(5)
    for _ in range(60):
        moves = rng.normal(0, 1, (3, 3)).astype(np.float32)
        e = rng.normal(0, 2, (6, 3)).astype(np.float32)
        e[rng.random(6) < 0.4, 0] += 12
        score = lambda p: sum(e[i, y] for i, y in enumerate(p)) + moves[0, p[0]] + sum(moves[a, b] for a, b in zip(p, p[1:])) + moves[p[-1], 0]
        best = max(itertools.product(range(3), repeat=6), key=score)
        got = S.tag(S.Model(np.zeros((1, 3)), moves), e, np.array([0, 6]))
        assert abs(score(tuple(got)) - score(best)) < 1e-3
        assert abs(score(tuple(S.viterbi(e, moves))) - score(best)) < 1e-3


def made(n, seed, marked=True):
    rng = random.Random(seed)
    words = ["the", "of", "reading", "Quiet,", "house.", "12", "2024", "+1 (203) 555-3887", "a.b@example.com", "10.0.12.7"]
    key = lambda k: "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGH0123456789") for _ in range(k))
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(30, 60))]
        if i % 2:
            at = rng.randrange(5, 25)
            w[at:at] = [f"password = {key(24)}"] if marked else ["credential", "is", key(24)]
        out.append((i, " ".join(w), "en", "a", 1))
    return out


def test_field_finds_unmarked_keys(spark):
    model = S.train(odd_docs(spark, made(400, 1)))
    rows = {r.doc_id: r.spans for r in S.find(odd_docs(spark, made(200, 2, False)), model).collect()}
    found = [any(s.kind == "crf" for s in rows[i]) for i in range(200)]
    assert np.mean(found[1::2]) > 0.9 and not any(found[0::2])
    text = {r[0]: r[1] for r in made(200, 2, False)}
    assert all(re.fullmatch("[A-Za-z0-9]{24}", text[i][s.start:s.end]) for i in range(200) for s in rows[i] if s.kind == "crf")


def test_report_and_odd_rows(spark):
    docs = odd_docs(spark)
    model = S.train(docs)
    rows = S.report(S.find(docs.drop("spans"), model)).collect()
    got = sorted((r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows)
    exp = []
    for r in odd_rows():
        w = want(r[1])
        exp.append((*(sum(x.startswith(k) for x in w) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(w).encode()).hexdigest()))
    assert got == sorted(exp)
    assert S.report(S.find(no_docs(spark), S.train(no_docs(spark)))).count() == 0


def test_text_of_very_many_spans(spark):
    text = "token: Ab1Ab1Ab1Ab1Ab1 é and 0123456789abcdef0 so it goes " * 20_000
    batch = pa.RecordBatch.from_pydict({"text": [text, "é password = abcdefghijkl " + "a house of words " * 9]})
    assert sum(b.num_rows for b in S._windows([batch])) <= 2 * (1 + S.TRAIN_SPANS) + 2 * 2
    docs = odd_docs(spark, [(1, text, "en", "a", len(text)), *made(40, 3)])
    row = S.report(S.find(docs.drop("spans"), S.train(docs))).where("doc_id = 1 and n_hex > 0").first()
    w = want(text)
    assert (row.n_assign, row.n_hex, row.base_sha256) == (20_000, 20_000, hashlib.sha256(",".join(w).encode()).hexdigest())
    assert [s for s in row.spans.split(",") if not s.startswith("crf")] == w


def test_found_spans_apart():
    rng = random.Random(3)
    for _ in range(500):
        cut = lambda: sorted((a, "hex", a + rng.randint(1, 9)) for a in (rng.randrange(40) for _ in range(rng.randint(0, 4))))
        found, spans = cut(), cut()
        assert S._apart(found, spans) == [f for f in found if not any(f[0] < e and s < f[2] for s, _, e in spans)]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in S.report(S.find(docs, S.train(docs))).collect()}
    for d in docs.collect():
        r, w = rows[d.doc_id], want(d.text)
        assert r.base_sha256 == hashlib.sha256(",".join(w).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("crf")] == w


def test_tokens():
    t = S.Tokens(pa.array(["ab-9/é x", "", None, "Q" * 50 + "=1"]))
    assert [bytes(t.raw[a:b]).decode() for a, b in zip(t.start, t.end)] == ["ab-9/", "x", "Q" * 50, "1"]
    assert np.diff(t.row_at).tolist() == [2, 0, 0, 2]
    assert (t.features >= S.OFFSETS).all() and (t.features < S.OFFSETS + np.array(S.SIZES)).all()
