import random
import re
from collections import Counter

import pyarrow as pa

from partsmith.llm import line_chunks
from odd import CLASHING, no_docs, odd_docs, odd_rows


def chunks_of(text):
    c = line_chunks.Chunks(pa.array([text]))
    raw = c.raw.tobytes()
    return [(raw[a:b], bool(w)) for a, b, w in zip(c.start, c.end, c.whole)]


def brute(rows):
    """(doc_id, text) -> text without repeats, with chunks compared as bytes."""
    count, first = Counter(), {}
    for d, t in rows:
        for b, w in chunks_of(t or ""):
            if w:
                count[b] += 1
                first[b] = min(first.get(b, d), d)
    out = []
    for d, t in rows:
        seen, kept = set(), []
        for b, w in chunks_of(t or ""):
            if w and count[b] > 1:
                if first[b] != d or b in seen:
                    continue
                seen.add(b)
            kept.append(b)
        out.append((d, None if t is None else b"".join(kept).decode()))
    return sorted(out)


def made():
    rng = random.Random(8)
    words = [f"v{i}" for i in range(900)] + ["é", "ß"]

    def prose(n):
        w = [rng.choice(words) + rng.choice(["", "", "", ",", "."]) + rng.choice([" "] * 9 + ["\n"]) for _ in range(n)]
        return "".join(w)

    passage = prose(70)
    out = []
    for i in range(60):
        t = prose(rng.randint(1, 120))
        if i % 3 == 0:
            t += passage + prose(rng.randint(1, 40))
        out.append((i, t))
    out += [(100 + i, out[5][1]) for i in range(3)]
    return out, passage


def test_same_as_comparing_all_chunks(spark):
    rows, passage = made()
    docs = odd_docs(spark, [(d, t, "en", "a", 1) for d, t in rows])
    got = line_chunks.remove_repeats(docs)
    assert got.columns == [*docs.columns, "n_removed", "removed_bytes"]
    found = got.collect()
    assert sorted((r.doc_id, r.text) for r in found) == brute(rows)
    assert sum(passage in r.text for r in found) <= 1
    given = dict(rows)
    assert all(len(given[r.doc_id].encode()) == len(r.text.encode()) + r.removed_bytes for r in found)
    alone = [r for r in found if r.doc_id % 3 and r.doc_id < 60]
    assert all(r.n_removed == 0 and r.text == given[r.doc_id] for r in alone)


def test_boundaries_do_not_move():
    rows, _ = made()
    text = rows[2][1] + rows[4][1] + rows[7][1]
    assert "".join(b.decode() for b, _ in chunks_of(text)) == text
    moved = {b for b, _ in chunks_of("Something else. New, " + text)}
    assert sum(b not in moved for b, _ in chunks_of(text)) <= 2


def test_hashes_do_not_depend_on_the_batch():
    texts = ["ab", "one two three four, five six seven eight. x", "one two three, four five six. " * 3, "y" * 9000 + " z, " + "word " * 3000 + ", end.", "short, line. " * 9]
    together = line_chunks.Chunks(pa.array(texts))
    alone = [line_chunks.Chunks(pa.array([t])) for t in texts]
    assert together.hash.tolist() == [h for c in alone for h in c.hash.tolist()]
    assert together.whole.tolist() == [h for c in alone for h in c.whole.tolist()]


def test_equal_hashes_of_unequal_chunks(spark, monkeypatch):
    """Every chunk gets the same hash; only truly equal bytes may go.  Runs on the driver's side of each step."""
    text, pieces = "abXXcdYYef", [{"at": 2, "hash": 1, "piece": b"11"}, {"at": 6, "hash": 2, "piece": b"22"}, {"at": -1, "hash": 2, "piece": b"zz"}]
    short = "abcd" + "ef"
    assert line_chunks.put_back(short, pieces, {1}) == "ab11cdef"
    assert line_chunks.put_back(short, pieces, {1, 2}) == "ab11cd22ef"
    assert line_chunks.put_back(short, pieces, set()) == short and text
    rows = pa.RecordBatch.from_pydict({"hash": [1, 1, 1, 2, 2], "salt": [0, 0, 0, 0, 0], "at": [-1, 4, 9, -1, 0],
                                       "doc_key": [7, 8, 9, 7, 8], "piece": [b"a", b"a", b"b", b"q", b"r"]})
    out = next(line_chunks._unequal([rows]))
    assert out.to_pylist() == [{"doc_key": 9, "hash": 1}, {"doc_key": 8, "hash": 2}]


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = line_chunks.remove_repeats(docs).collect()
    assert len(got) == len(odd_rows()) and got[0].shard == "extra" and all(getattr(got[0], c) == "extra" for c in CLASHING)
    assert sorted(re.sub("x{50,}", "x", str(r.text)[:50]) for r in got) == sorted(re.sub("x{50,}", "x", str(r[1])[:50]) for r in odd_rows())
    assert line_chunks.remove_repeats(no_docs(spark)).count() == 0
    twice = odd_docs(spark, [(None, "one two three, four five six. seven eight nine, ten\n" * 3, None, None, None)] * 2)
    assert len({r.text for r in line_chunks.remove_repeats(twice).collect()}) == 1


def test_share_of_planted_passages_that_goes():
    """By length and kind of passage: chunks common to both copies, in other surroundings; from about 50 words on hardly any is missed."""
    rng = random.Random(21)
    words = [f"v{i}" for i in range(900)]

    def prose(n, marks):
        return "".join(rng.choice(words) + (rng.choice(["", "", "", ",", "."]) if marks else "") + " " for _ in range(n))

    def share(make, size):
        gone = []
        for _ in range(150):
            passage = make(size)
            one, other = ({b for b, w in chunks_of(prose(30, True) + passage + prose(30, True)) if w} for _ in range(2))
            gone.append(sum(map(len, one & other)) / len(passage.encode()))
        return sum(g > 0 for g in gone) / len(gone), sum(gone) / len(gone)

    signs = "".join(chr(0x4E00 + i) for i in range(800))
    kinds = {"marks": lambda n: prose(n, True), "no marks": lambda n: prose(n, False), "no spaces": lambda n: "".join(rng.choice(signs) for _ in range(2 * n)) + " "}
    for make in kinds.values():
        found, gone = share(make, 50)
        assert found > 0.75 and gone > 0.25
        found, gone = share(make, 100)
        assert found > 0.98 and gone > 0.6
        found, gone = share(make, 300)
        assert found == 1 and gone > 0.8


def test_one_line_and_one_word_over_and_over():
    text = "word " * 400
    assert {b for b, w in chunks_of("a b c " + text) if w} & {b for b, w in chunks_of("other, and. " + text) if w}
    assert max(len(b.split()) for b, _ in chunks_of(text)) <= line_chunks.MOST_WORDS
