import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from partsmith.llm import token_files
from partsmith.session import new_path
from odd import no_docs, odd_docs, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = token_files.Encoder(PATH)


def want_of(texts):
    out, start = [], 0
    for t in texts:
        ids = PLAIN.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_equals_plain_encoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    got = [tuple(r)[1:] for r in sorted(token_files.round_trip(docs, PATH).collect())]
    assert got == want_of([r.text for r in rows])


def test_odd_rows(spark):
    got = token_files.round_trip(odd_docs(spark), PATH).collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert sorted(r[1:] for r in got) == want_of([r[1] for r in rows])
    assert token_files.round_trip(no_docs(spark), PATH).collect() == []


def test_selective_reads(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs, PATH, path)
    part = token_files.read_tokens(spark, path, 20, 29)
    assert sorted(r.doc_id for r in part.collect()) == list(range(20, 30))
    plan = part._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in plan and "LessThanOrEqual(doc_id,29)" in plan
    assert "ids:" not in token_files.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\r\x1c\x85 'sSΣıİé́ÀßÿÖ.,!?;<|>endoftext"))))
def test_pieces_between_white_space(text):
    ids, at = ENCODER.encode(pa.array([None, text, "", text]))
    assert at.tolist() == [0, 0, len(ids) // 2, len(ids) // 2, len(ids)]
    assert ids[:len(ids) // 2].tolist() == ids[len(ids) // 2:].tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_memory_of_a_batch():
    import tracemalloc

    from partsmith.llm.words import slices

    batch = pa.RecordBatch.from_pydict({"text": ["a few plain words of text, again and again. " * 400] * 900})
    tracemalloc.start()  # sees arrays and objects of Python; 16 MB of text
    for part in slices(batch, most=token_files.BATCH_BYTES):
        ENCODER.encode(part.column("text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # 91 MB at 8 MB a batch, 23 MB at 2
