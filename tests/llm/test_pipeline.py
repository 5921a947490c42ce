import corpus_pipeline as C
import public_tokenizers as P
import tiktoken

import test_line_chunks
import test_minhash
from odd import no_docs, odd_docs
from partsmith.llm import toxicity
from partsmith.session import stage
from test_byte_bpe import RANKS
from test_decontamination import plain, words_of

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, step in C.STAGES:
        seen.append(stage(step(spark, seen[-1], SF), name))
    rows = [s.collect() for s in seen]
    assert all(s.columns == docs.columns for s in seen[:-1])

    model = toxicity.fit(toxicity.labelled_rows(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {r.doc_id for r in toxicity.score(docs, model).filter("toxic_predicted = 0").select("doc_id").collect()}
    assert {r.doc_id for r in rows[1]} == kept and 0 < len(kept) < len(rows[0])

    cut = [(d, t) for d, t in test_line_chunks.brute([(r.doc_id, r.text) for r in rows[1]])]
    given = {r.doc_id: r.text for r in rows[1]}
    assert sorted((r.doc_id, r.text) for r in rows[2]) == [(d, t) for d, t in cut if t == given[d] or t.strip(" \n\t\r")]
    assert all(r.n_chars == len(r.text) for r in rows[2])

    classes = test_minhash.brute([(r.doc_id, r.text) for r in rows[2]], 5)
    assert sorted(r.doc_id for r in rows[3]) == sorted({c for _, _, c in classes})

    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in rows[4]}
    for r in rows[3]:
        if len(r.text) < 3000:
            w = words_of(r.text)
            assert (r.doc_id in left) == all(plain(i, w) < len(i) for i in items)

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    texts = {r.doc_id: r.text for r in rows[4]}
    assert {r.doc_id: (r.ids, r.n_tokens, r.restored) for r in rows[5]} == {
        d: (ids := enc.encode_ordinary(t), len(ids), True) for d, t in texts.items()}
    assert sorted(r.doc_id for r in C.run(spark, SF).collect()) == sorted(texts)


def test_odd_rows(spark):
    for docs in (odd_docs(spark), no_docs(spark)):
        n = docs.count()
        for name, step in C.STAGES:
            out = step(spark, docs, SF)
            if name != "byte_bpe":
                assert out.columns == docs.columns
            docs = stage(out, name)
            assert docs.count() <= n
