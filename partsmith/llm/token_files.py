"""Token ids as Parquet files made for selective reads.

A token table is a folder with two Parquet tables:

* ``tokens``: one row per document in ascending doc_id order: ``part`` (number
  of the file), ``doc_id``, ``local_start`` (ids before it in its part),
  ``n_tokens`` and ``ids`` (list of ids, the end id included).  Ids are
  dictionary encoded, the numbers delta encoded; row groups and pages are kept
  small and page indexes are written, so that a filter on ``doc_id`` or a read
  of ``n_tokens`` alone touches few bytes;
* ``parts``: one row per part with the number of documents and ids, and the
  ids of all parts before it.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from partsmith.llm.store import Store
from partsmith.llm.words import column_bytes, slices
from partsmith.session import new_path

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 2000
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


BATCH_BYTES = 2 << 20
#: Latin letters that are in normal form and have one lower-case letter each
_LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF"
_WORD = re.compile(f"[{_LETTERS}]+")
_MARKS = "!#$%&*,.:;?|"
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 13]] = True


def _gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` one after the other, and where each begins (the total at the end)."""
    at = np.concatenate([[0], np.cumsum(length)])
    return values[np.repeat(start - at[:-1], length) + np.arange(at[-1])], at


class Encoder:
    """Ids of texts by the tokenizers library.

    No pre-token, normal form or special token reaches across white space, so
    a piece between spaces, tabs and line breaks is encoded alone, once per
    batch and, while the bounded store keeps it, once per worker.  A Latin word
    with marks after it is put together from the ids of both, since letters
    and other marks are always separate pre-tokens; new words are encoded many
    at a time and told apart by the word end in the vocabulary.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.store = Store(self._learn, 400_000)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", found.ids).tobytes() for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 500):
            some = words[at:at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):  # a vocabulary without word ends
                out += self._ids(some)
                continue
            raw, begin = ids.tobytes(), 0
            for end in (ends * 4).tolist():
                out.append(raw[begin:end])
                begin = end
        return out

    def _learn(self, keys: list[str]) -> list[bytes]:
        plain = [_WORD.fullmatch(k) is not None for k in keys]
        words = iter(self._learn_words([k for k, p in zip(keys, plain) if p]))
        other = iter(self._ids([k for k, p in zip(keys, plain) if not p]))
        return [next(words if p else other) for p in plain]

    def _known(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key the start and number of its ids among the ids of all distinct keys."""
        coded = keys.dictionary_encode()
        packed = self.store.values(coded.dictionary.to_pylist())
        length = np.array([len(p) // 4 for p in packed], np.int64)
        start, code = np.cumsum(length) - length, coded.indices.to_numpy()
        return np.frombuffer(b"".join(packed), "<u4"), start[code], length[code]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces one after the other, and where each begins."""
        stems = pc.ascii_rtrim(pieces, _MARKS)
        word = pc.match_substring_regex(stems, f"^[{_LETTERS}]+$")
        keys = pc.if_else(word, pc.utf8_lower(stems), pieces)
        sizes, cut = (pc.binary_length(x).to_numpy() for x in (pieces, stems))
        raw, ends = column_bytes(pieces)
        marks, at = _gather(raw, ends[:-1] + cut, np.where(word.to_numpy(zero_copy_only=False), sizes - cut, 0))
        marks = pa.Array.from_buffers(pa.large_string(), len(pieces), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(marks.tobytes())])
        ids, start, length = self._known(keys)
        more, start2, length2 = self._known(marks.cast(pa.string()))
        both = np.stack([start, start2 + len(ids)], axis=1).ravel()
        out, at = _gather(np.concatenate([ids, more]), both, np.stack([length, length2], axis=1).ravel())
        return out, at[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins (the total at the end); nulls have none."""
        raw, rows = column_bytes(texts)
        raw = np.where(_GAP[raw], np.uint8(32), raw)
        spaced = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(raw.tobytes())])
        lists = pc.split_pattern(spaced.cast(pa.string()), " ")
        coded = lists.values.dictionary_encode()
        ids, at = self._distinct(coded.dictionary)
        code = coded.indices.to_numpy()
        out, begins = _gather(ids, at[:-1][code], np.diff(at)[code])
        return out, begins[lists.offsets.to_numpy()]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that its store stays warm."""
    return Encoder(path)


def _encode_part(path: str, end_id: int):
    def run(batches):
        part, start, encoder = TaskContext.get().partitionId(), 0, encoder_of(path)
        for whole in batches:
            for batch in slices(whole, most=BATCH_BYTES):
                ids, at = encoder.encode(batch.column("text"))
                n = np.diff(at) + 1
                flat = np.insert(ids, at[1:], end_id).astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), pa.array(start + offsets[:-1]), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"])
                start += int(offsets[-1])

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode every text (null: empty), append ``end_id`` and write the table in ascending doc_id order.

    Rows with a null doc_id come first; rows that share a doc_id follow each other by text and each keep a row.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    (ordered.mapInArrow(_encode_part(tokenizer_path, end_id), SCHEMA).write
        .option("compression", "zstd").option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true")
        .parquet(f"{path}/tokens"))
    sizes = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # one row per part, so a single task is enough to add up
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("first_id", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{path}/parts")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens of every document; ids are not read."""
    tokens = spark.read.schema(SCHEMA).parquet(f"{path}/tokens").select("part", "doc_id", "local_start", "n_tokens")
    return _with_start(tokens, path).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids, of a range of doc_id if asked for; the range reaches the page index."""
    tokens = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    if first_doc is not None:
        tokens = tokens.filter(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        tokens = tokens.filter(F.col("doc_id") <= last_doc)
    return _with_start(tokens, path).select("doc_id", "start", "n_tokens", "ids")


def _with_start(tokens: DataFrame, path: str) -> DataFrame:
    parts = tokens.sparkSession.read.parquet(f"{path}/parts").select("part", "first_id")
    return tokens.join(parts, "part").withColumn("start", F.col("first_id") + F.col("local_start"))


def _crc(batches):
    import zlib

    for batch in batches:
        ids = batch.column("ids")
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
        at = ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(tokens: DataFrame) -> DataFrame:
    """Checksum of the ids of each document as little-endian unsigned 32-bit integers."""
    return tokens.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token table to the shared folder and describe each document as read back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path)
    return digests(read_tokens(docs.sparkSession, path))
