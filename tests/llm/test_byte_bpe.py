import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings, strategies as st

from partsmith.llm import byte_bpe
from odd import no_docs, odd_docs, odd_rows

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def want(text):
    ids = np.array(PLAIN.encode_ordinary(text or ""), "<u4").tobytes()
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_perfect_hash_is_minimal():
    v = byte_bpe.vocabulary(PATH)
    assert all(x is not None for x in v.at_slot) and len(v.at_slot) == len(RANKS)
    some = list(RANKS)[::97]
    assert v.whole(some) == [RANKS[t] for t in some]
    assert v.whole([b"not a token at all", b""]) == [-1, -1]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\r\x0b\x1c\x85　 'stSlL1234abc.,"))))
def test_same_ids_as_the_plain_encoder(text):
    assert np.frombuffer(byte_bpe.Encoder(PATH, P.PATTERN).encode([text])[0], "<u4").tolist() == PLAIN.encode_ordinary(text)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in byte_bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    assert got == {r.doc_id: want(r.text) for r in docs.collect()}


def test_ids_and_bytes(spark):
    docs = odd_docs(spark)
    coded = byte_bpe.encode(docs, PATH, P.PATTERN)
    back = sorted(r.bytes for r in byte_bpe.decode(coded, PATH).collect())
    assert back == sorted((r[1] or "").encode() for r in odd_rows())
    assert sorted(r.n_tokens for r in coded.collect()) == sorted(want(r[1])[0] for r in odd_rows())
    assert sorted(tuple(r)[1:] for r in byte_bpe.round_trip(docs, PATH, P.PATTERN).collect()) == sorted(want(r[1]) for r in odd_rows())
    assert byte_bpe.round_trip(no_docs(spark), PATH, P.PATTERN).collect() == []
