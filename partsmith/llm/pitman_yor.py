"""Language-model scores of a hierarchical Pitman-Yor model.

Restaurants stand in a hierarchy in which those of one level share a parent:

    word after a word         one restaurant per class of the word before: 20 bits of its hash, or the beginning
    -> word                   one restaurant
    -> byte after two bytes   the spelling of a word, one restaurant per pair of bytes
    -> byte after one byte
    -> byte -> uniform

Customers are the training tokens.  Each table of a restaurant is a customer of
its parent, so rare words get their probability from their spelling.  Seatings
are sampled by Gibbs sweeps: all customers of a dish are seated anew, one after
the other, given the tables of all other dishes as they were after the sweep
before; that keeps words independent within a sweep, so sweeps are parallel
over words.  Predictive probabilities are averaged over the samples.

Words are dealt to buckets by their hash; the number of buckets follows the
bytes of the texts, so that a bucket holds about BUCKET_BYTES of them.  A chunk
of documents counts its pairs and sends one row per bucket; a bucket's state is
one row, whose numbers are packed as bytes.  A word that has a share of 1/1024
of the tokens or more (at most 1024 such words) is cut by its contexts into as
many slices as there are buckets, up to 4096; its total lives with the totals
that words share.  To score, each chunk sends the places of its words to the
buckets, where the bucket's state stands first; what comes back per document
are sums.  Only totals per class of context (2**20) and the counts of byte
triples (2**16 * 257 at most) reach the driver and are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from partsmith.llm.words import LOWER, MULT, Words, mix, slices
from partsmith.session import new_path, remove

CHUNK_BYTES, CHUNK_DOCS, STEP_DOCS = 16 << 20, 50_000, 10_000  # documents of a chunk are numbered in 16 bits
BUCKET_BYTES = 4 << 20
CONTEXT_BITS = 20
BEGIN = 1 << CONTEXT_BITS  # context of the first token
CONTEXTS = BEGIN + 1
HOT_WORDS, HOT_SAMPLE_BYTES, SLICE_BITS = 1024, 16 << 20, 12
BURN_IN, SAMPLES = 1, 2
SEED = 11
STRENGTH = 1.0
BYTE_DISCOUNT = 0.5
END_WORD, END_HASH = b"\xff", np.uint64(0x9D5C1A7F3B2E4811)  # no UTF-8 text holds this byte
STOP = 256  # after the last byte of a word
SYMBOLS = 257
FLUSH_ROWS = 2_000_000
MERGE_PAIRS = 1_000_000
ZIP_BYTES = 4096  # rows of more bytes than this on average are compressed before they travel


# ---------------------------------------------------------------- numbers as bytes

def _bytes(values: np.ndarray, kind: str) -> np.ndarray:
    """Numbers as bytes; kind ``u3`` keeps 24 bits."""
    if kind == "u3":
        return np.ascontiguousarray(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)[:, :3]).ravel()
    return np.ascontiguousarray(values, kind).view(np.uint8).ravel()


def _reader(batch: pa.RecordBatch, i: int):
    """A function that gives a binary column's numbers in row ``i``."""
    zipped = batch.column("zipped")[i].as_py()

    def get(name: str, kind: str) -> np.ndarray:
        raw = batch.column(name)[i].as_buffer()
        return _numbers(zstandard.ZstdDecompressor().decompress(raw) if zipped and len(raw) else raw, kind)

    return get


def _row_batch(columns: list[pa.Array], schema: str) -> pa.RecordBatch:
    """Columns in the order of ``schema``, whose last one says whether binary columns are compressed."""
    n = len(columns[0])
    binary = [c for c in columns if pa.types.is_binary(c.type)]
    zipped = sum(c.nbytes for c in binary) > n * ZIP_BYTES
    if zipped:
        press = zstandard.ZstdCompressor(level=1)
        columns = [pa.array([press.compress(x) if len(x) else b"" for x in (v.as_buffer() for v in c)], pa.binary())
                   if pa.types.is_binary(c.type) else c for c in columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, zipped))], names=_names(schema))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _numbers(raw, kind: str) -> np.ndarray:
    raw = np.frombuffer(raw, np.uint8)
    if kind == "u3":
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, :3] = raw.reshape(-1, 3)
        return wide.view("<u4").ravel().astype(np.int64)
    return raw.view(kind)


def _packs(at: np.ndarray, values: np.ndarray, kind: str) -> pa.Array:
    """Runs of numbers as a binary column; ``at``: where each begins, the total at the end."""
    size = 3 if kind == "u3" else np.dtype(kind).itemsize
    return pa.Array.from_buffers(
        pa.binary(), len(at) - 1, [None, pa.py_buffer((np.asarray(at) * size).astype(np.int32)), pa.py_buffer(_bytes(values, kind).tobytes())])


def _empty(n: int) -> pa.Array:
    """Bytes of nothing, not null: Spark asks for the size of a batch at every row, and that takes long for columns of nulls."""
    return _packs(np.zeros(n + 1, np.int64), np.zeros(0), "<f8")


def _one(values: np.ndarray, kind: str) -> pa.Array:
    return _packs(np.array([0, values.size]), values, kind)


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def _words(lengths: np.ndarray, raw: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(_starts(lengths)), pa.py_buffer(raw.tobytes())])


def _lengths(words: pa.Array) -> np.ndarray:
    return pa.compute.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def _raw(words: pa.Array) -> np.ndarray:
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)


# ---------------------------------------------------------------- texts to words

class Chunk:
    """The tokens of some documents: hash, context, document, and bytes of each distinct word."""

    def __init__(self):
        self.hash, self.context, self.doc, self.first, self.length = [], [], [], [], []
        self.raw, self.bytes, self.doc_ids, self.held = [], 0, [], []

    def add(self, batch: pa.RecordBatch) -> None:
        w, n, base = Words(batch.column("text")), len(batch), len(self.doc_ids)
        rows, per_row = w.row_of_word(), np.diff(w.row_at)
        ends = w.row_at[1:] + np.arange(n)  # place of each document's end among its tokens
        total = len(w.hash) + n
        word = np.ones(total, bool)
        word[ends] = False
        token_hash = np.empty(total, np.uint64)
        token_hash[word], token_hash[~word] = w.hash, END_HASH
        context = np.empty(total, np.int32)
        context[1:] = (token_hash[:-1] >> np.uint64(64 - CONTEXT_BITS)).astype(np.int32)
        context[ends - per_row] = BEGIN
        start, length = np.zeros(total, np.int64), np.zeros(total, np.int32)
        start[word], length[word] = w.start + self.bytes, w.end - w.start
        doc = np.empty(total, np.int32)
        doc[word], doc[~word] = rows + base, np.arange(n) + base
        for to, x in ((self.hash, token_hash), (self.context, context), (self.doc, doc), (self.first, start), (self.length, length)):
            to.append(x)
        self.raw.append(LOWER[w.raw])
        self.bytes += len(w.raw)
        self.doc_ids += batch.column("doc_id").to_pylist()
        self.held += batch.column("held_out").to_pylist()

    def arrays(self):
        return [np.concatenate(x) for x in (self.hash, self.context, self.doc, self.first, self.length)]


def _chunks(batches):
    chunk = Chunk()
    for whole in batches:
        for cut in slices(whole):
            for at in range(0, len(cut), STEP_DOCS):
                chunk.add(cut.slice(at, STEP_DOCS))
                if chunk.bytes >= CHUNK_BYTES or len(chunk.doc_ids) >= CHUNK_DOCS:
                    yield chunk
                    chunk = Chunk()
    if chunk.doc_ids:
        yield chunk


def _spelling(raw: np.ndarray, first: np.ndarray, length: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of words and their bytes one after the other; the end is a word of one byte."""
    length = np.where(end, 1, length).astype(np.int64)
    at = _starts(length)
    place = np.arange(at[-1]) - np.repeat(at[:-1] - np.where(end, 0, first), length)
    data = raw[np.minimum(place, max(len(raw) - 1, 0))] if len(raw) else np.zeros(at[-1], np.uint8)
    data[np.repeat(end, length)] = END_WORD[0]
    return length, data


@dataclass
class Layout:
    """Buckets (a power of two), and the words that are cut into slices."""

    bits: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    words: pa.Array | None = None

    def keys(self, h: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is dealt to buckets: the hash of a word, or of a slice of a hot one; and which hot word it is (-1: none)."""
        index = np.full(len(h), -1, np.int16)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
            hot = np.flatnonzero(self.hot[at] == h)
            index[hot] = at[hot]
            part = context[hot] >> (CONTEXT_BITS - min(self.bits, SLICE_BITS))
            h = h.copy()
            h[hot] = mix(h[hot] + (part.astype(np.uint64) + np.uint64(1)) * MULT)
        return h, index

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)


def _heavy(batches):
    """Words of a batch and how often they occur; the row without a word counts all."""
    for chunk in _chunks(batches):
        h, _, _, first, length = chunk.arrays()
        found, at, n = np.unique(h, return_index=True, return_counts=True)
        much = np.flatnonzero(n * (4 * HOT_WORDS) >= len(h))  # a frequent word is frequent in most chunks
        lengths, raw = _spelling(np.concatenate(chunk.raw), first[at[much]], length[at[much]], found[much] == END_HASH)
        words = _words(lengths, raw).cast(pa.binary()).to_pylist() + [None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found[much].view(np.int64), 0)), pa.array(words, pa.binary()), pa.array(np.append(n[much], len(h)))],
            names=["hash", "word", "n"])


def plan(docs: DataFrame) -> Layout:
    """Buckets from the bytes of all texts; hot words from about HOT_SAMPLE_BYTES of texts chosen by hash.

    The sample decides only which words are cut into slices, hence how evenly
    tasks are filled; every count is over all texts.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (-(-total // BUCKET_BYTES) - 1).bit_length())
    if not bits:
        return Layout(0)
    every = max(1, total // HOT_SAMPLE_BYTES)
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).mapInArrow(_heavy, "hash long, word binary, n long")
    top = some.groupBy("hash", "word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "hash").limit(HOT_WORDS + 1).collect()
    tokens = sum(r["n"] for r in top if r["word"] is None)
    hot = sorted((r["hash"] % 2**64, bytes(r["word"])) for r in top if r["word"] is not None and r["n"] * HOT_WORDS >= tokens)
    return Layout(bits, np.array([h for h, _ in hot], np.uint64), pa.array([w for _, w in hot], pa.large_binary()))


def _bounds(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the total at the end."""
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values))


COUNTED = "bucket long, keys binary, hot binary, lengths binary, raw binary, n binary, contexts binary, counts binary, zipped boolean"


def _count_words(layout: Layout):
    """Per chunk and bucket: its words, the contexts of each, and how often it follows them."""

    def run(batches):
        for chunk in _chunks(batches):
            h, context, _, first, length = chunk.arrays()
            keys, hot = layout.keys(h, context)
            order = np.lexsort((context, keys))
            keys, context = keys[order], context[order]
            pair = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (context[1:] != context[:-1])))
            counts = np.diff(np.append(pair, len(keys)))
            at = _bounds(keys[pair])  # first pair of each word
            word = pair[at[:-1]]
            token = order[word]
            lengths, raw = _spelling(np.concatenate(chunk.raw), first[token], length[token], h[token] == END_HASH)
            bucket = layout.bucket(keys[word])
            row = _bounds(bucket)
            yield _row_batch(
                [pa.array(bucket[row[:-1]]), _packs(row, keys[word], "<u8"), _packs(row, hot[token], "<i2"), _packs(row, lengths, "<u4"),
                 _packs(_starts(lengths)[row], raw, "u1"), _packs(row, np.diff(at), "<u4"), _packs(at[row], context[pair], "u3"),
                 _packs(at[row], counts, "<i8")], COUNTED)

    return run


# ---------------------------------------------------------------- the state of a bucket

STATE = ("bucket long, keys binary, hot binary, lengths binary, raw binary, n binary, contexts binary, counts binary, tables binary, "
         "customers binary, word_tables binary, seen binary, roots binary, zipped boolean")


@dataclass
class Bucket:
    """Words (sorted by key) and their pairs: ``n`` pairs each, sorted by context.

    ``tables`` are those of the pairs, ``customers`` their sums by word, ``word_tables`` the tables of words in the
    restaurant of words; ``seen`` keeps the tables and ``roots`` the words' probabilities of each sample.
    """

    keys: np.ndarray
    hot: np.ndarray
    words: pa.Array
    n: np.ndarray
    contexts: np.ndarray
    counts: np.ndarray
    tables: np.ndarray
    customers: np.ndarray
    word_tables: np.ndarray
    seen: np.ndarray  # pair x sample
    roots: np.ndarray  # word x sample

    def row(self, bucket: int) -> pa.RecordBatch:
        return _row_batch(
            [pa.array([bucket], pa.int64()), _one(self.keys, "<u8"), _one(self.hot, "<i2"), _one(_lengths(self.words), "<u4"), _one(_raw(self.words), "u1"),
             _one(self.n, "<u4"), _one(self.contexts, "u3"), _one(self.counts, "<i8"), _one(self.tables, "<i8"), _one(self.customers, "<i8"),
             _one(self.word_tables, "<i8"), _one(self.seen, "<i8"), _one(self.roots, "<f8")], STATE)

    def word(self) -> np.ndarray:
        """The word of each pair."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over the pairs of each word; every word has some."""
        return np.add.reduceat(values, _starts(self.n)[:-1])


def read_buckets(batch: pa.RecordBatch):
    """(bucket, its state) of each row."""
    for i, bucket in enumerate(batch.column("bucket").to_pylist()):
        get = _reader(batch, i)
        n, contexts = get("n", "<u4").astype(np.int64), get("contexts", "u3")
        yield bucket, Bucket(
            get("keys", "<u8"), get("hot", "<i2"), _words(get("lengths", "<u4"), get("raw", "u1")), n, contexts, get("counts", "<i8"), get("tables", "<i8"),
            get("customers", "<i8"), get("word_tables", "<i8"), get("seen", "<i8").reshape(len(contexts), -1), get("roots", "<f8").reshape(len(n), -1))


def _add(parts: list[tuple]) -> tuple:
    """Counts of several chunks as one."""
    keys, hot, lengths, raw, n, contexts, counts = (np.concatenate(x) for x in zip(*parts))
    keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
    words = _words(lengths, raw).take(pa.array(first))
    code, pair = np.unique(np.repeat(back, n) * CONTEXTS + contexts, return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, pair, counts)
    n = np.diff(np.searchsorted(code, np.arange(len(keys) + 1) * CONTEXTS))
    return keys, hot[first], _lengths(words), _raw(words), n, code % CONTEXTS, total


def _merge_words(batches):
    """Rows come sorted by bucket; those of a bucket are added up, a million pairs at a time."""

    def finish(bucket, parts):
        keys, hot, lengths, raw, n, contexts, counts = _add(parts)
        return Bucket(keys, hot, _words(lengths, raw), n, contexts, counts, np.ones(len(counts), np.int64), n, (hot < 0).astype(np.int64),
                      np.zeros((len(counts), 0), np.int64), np.zeros((len(keys), 0))).row(bucket)

    bucket, parts, pending = None, [], 0
    for batch in batches:
        for i, b in enumerate(batch.column("bucket").to_pylist()):
            if b != bucket and parts:
                yield finish(bucket, parts)
                parts, pending = [], 0
            bucket = b
            # bytes of a batch are copied, since a batch does not outlive its turn
            parts.append(tuple(_reader(batch, i)(c, kind).astype(to) for c, kind, to in (
                ("keys", "<u8", np.uint64), ("hot", "<i2", np.int16), ("lengths", "<u4", np.int64), ("raw", "u1", np.uint8), ("n", "<u4", np.int64),
                ("contexts", "u3", np.int64), ("counts", "<i8", np.int64))))
            pending += len(parts[-1][-1])
            if pending > MERGE_PAIRS + 2 * len(parts[0][-1]):
                parts, pending = [_add(parts)], 0
    if parts:
        yield finish(bucket, parts)


# ---------------------------------------------------------------- the model

def seat(customers: np.ndarray, strength: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables taken by the customers of each dish, seated one after the other.

    A customer opens a table with odds of ``strength`` (what the restaurant
    gives new tables, times the parent's probability of the dish) against
    customers - discount * tables.  From 32 customers on they come in groups
    of a sixteenth of those seated, for whom the odds stay the same.
    """
    n = np.minimum(customers, 1).astype(np.float64)
    tables = n.copy()
    left = np.flatnonzero(customers > 1)
    while len(left):
        seated, k, a = n[left], tables[left], strength[left]
        group = np.minimum(np.maximum(1, seated // 16), customers[left] - seated)
        k = k + rng.binomial(group.astype(np.int64), a / (a + seated - discount * k))
        tables[left], n[left] = k, seated + group
        left = left[n[left] < customers[left]]
    return tables.astype(np.int64)


@dataclass
class Spelling:
    """Probabilities of bytes: triples that occur, and what is left to the parent."""

    keys: np.ndarray  # (first * 256 + second) * SYMBOLS + third, sorted
    triple: np.ndarray
    left2: np.ndarray  # per pair of bytes
    double: np.ndarray  # second x third

    def words(self, words: pa.Array) -> np.ndarray:
        """Probability of each word's spelling; 0 where it is too small for a double."""
        return np.exp(self.log_words(words))

    def log_words(self, words: pa.Array) -> np.ndarray:
        """Natural logarithm of the probability of each word's spelling; finite at any length."""
        words = words.cast(pa.large_binary())
        lengths = pa.compute.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(words):
            return np.zeros(0)
        key = triples(words, lengths)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        pair, third = key // SYMBOLS, key % SYMBOLS
        p = self.left2[pair] * self.double[pair % 256, third]
        p = p + np.where(known, self.triple[at], 0) if len(self.keys) else p
        return np.add.reduceat(np.log(p), np.cumsum(lengths + 1) - lengths - 1)


def triples(words: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """Keys of all (byte, byte, byte or STOP) of the words one after the other; 0 stands before a word."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    total = int((lengths + 1).sum())
    ends = np.cumsum(lengths + 1) - 1
    third = np.full(total, STOP, np.int64)
    inner = np.ones(total, bool)
    inner[ends] = False
    third[inner] = raw
    second, first = np.zeros(total, np.int64), np.zeros(total, np.int64)
    second[1:] = third[:-1]
    second[ends - lengths] = 0
    first[1:] = second[:-1]
    first[ends - lengths] = 0
    return (first * 256 + second) * SYMBOLS + third


@dataclass
class Totals:
    """What words share after a sweep."""

    context_tokens: np.ndarray
    context_tables: np.ndarray
    customers: int
    tables: int
    discount: float
    word_discount: float
    spelling: Spelling
    hot_tokens: np.ndarray
    hot_customers: np.ndarray
    hot_tables: np.ndarray

    def __getstate__(self):
        """Broadcasts are kept on the disk of every executor, so numbers of contexts, mostly small, are compressed."""
        press = zstandard.ZstdCompressor(level=1)
        return self.__dict__ | {c: press.compress(self.__dict__[c].tobytes()) for c in ("context_tokens", "context_tables")}

    def __setstate__(self, state):
        self.__dict__ = state | {c: np.frombuffer(zstandard.ZstdDecompressor().decompress(state[c]), np.int64) for c in ("context_tokens", "context_tables")}

    def root(self, customers, word_tables, spelled):
        """Probability of a word without its context."""
        d, n = self.word_discount, STRENGTH + self.customers
        return np.maximum(0, customers - d * word_tables) / n + (STRENGTH + d * self.tables) / n * spelled

    def roots(self, b: Bucket, spelled: np.ndarray) -> np.ndarray:
        """Probability of each word of a bucket without its context; slices of a hot word have that of the whole word."""
        customers, tables = b.customers.copy(), b.word_tables.copy()
        hot = b.hot >= 0
        customers[hot], tables[hot] = self.hot_customers[b.hot[hot]], self.hot_tables[b.hot[hot]]
        return self.root(customers, tables, spelled)

    def log_strange(self, words: pa.Array) -> np.ndarray:
        """Natural logarithm of the probability of words that do not occur, without their context."""
        return np.log((STRENGTH + self.word_discount * self.tables) / (STRENGTH + self.customers)) + self.spelling.log_words(words)

    def left(self) -> np.ndarray:
        """What each context leaves to its parent."""
        return (STRENGTH + self.discount * self.context_tables) / (STRENGTH + self.context_tokens)

    def own(self, contexts: np.ndarray, counts: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """What pairs have of their own in their restaurants."""
        return np.maximum(0, counts - self.discount * tables) / (STRENGTH + self.context_tokens[contexts])


def sample_spelling(keys: np.ndarray, counts: np.ndarray, before: Spelling | None, rng) -> Spelling:
    """Seat the byte levels for given customers of the triples; bounded by 2**16 * SYMBOLS rows."""
    d = BYTE_DISCOUNT
    pair, third = keys // SYMBOLS, keys % SYMBOLS
    second = pair % 256
    double_key = second * SYMBOLS + third
    total2 = np.bincount(pair, counts, 65536)
    parent = before.double if before is not None else np.full((256, SYMBOLS), 1 / SYMBOLS)
    tables2 = np.bincount(pair, minlength=65536).astype(np.float64)
    t2 = seat(counts, (STRENGTH + d * tables2)[pair] * parent[second, third], d, rng) if len(keys) else counts
    tables2 = np.bincount(pair, t2, 65536)
    c1 = np.bincount(double_key, t2, 256 * SYMBOLS).reshape(256, SYMBOLS)
    seen = np.count_nonzero(c1, axis=1)
    flat = (c1.sum(axis=0) + 1) / (c1.sum() + SYMBOLS)
    t1 = seat(c1.ravel().astype(np.int64), ((STRENGTH + d * seen)[:, None] * flat).ravel(), d, rng).reshape(c1.shape)
    c0 = t1.sum(axis=0)
    t0 = seat(c0, (STRENGTH + d * np.count_nonzero(c0)) / SYMBOLS * np.ones(SYMBOLS), d, rng)
    n0 = STRENGTH + c0.sum()
    single = np.maximum(0, c0 - d * t0) / n0 + (STRENGTH + d * t0.sum()) / n0 / SYMBOLS
    n1 = (STRENGTH + c1.sum(axis=1))[:, None]
    double = np.maximum(0, c1 - d * t1) / n1 + (STRENGTH + d * t1.sum(axis=1))[:, None] / n1 * single
    return Spelling(keys, np.maximum(0, counts - d * t2) / (STRENGTH + total2)[pair], (STRENGTH + d * tables2) / (STRENGTH + total2), double)


def _sweep(totals, number: int, evaluate: bool, resample: bool):
    """Keep the present sample, then seat the customers of every word anew."""

    def run(batches):
        g: Totals = totals.value
        for batch in batches:
            for bucket, b in read_buckets(batch):
                spelled = g.spelling.words(b.words)
                root = g.roots(b, spelled)
                if evaluate:
                    b.seen, b.roots = np.column_stack([b.seen, b.tables]), np.column_stack([b.roots, root])
                if resample:
                    rng = np.random.default_rng([SEED, number, bucket])
                    b.tables = seat(b.counts, (STRENGTH + g.discount * g.context_tables)[b.contexts] * root[b.word()], g.discount, rng)
                    b.customers = b.sums(b.tables)
                    b.word_tables = seat(np.where(b.hot < 0, b.customers, 0), (STRENGTH + g.word_discount * g.tables) * spelled, g.word_discount, rng)
                yield b.row(bucket)

    return run


#: numbers of what is summed: contexts (tokens, tables), byte triples (customers), single totals, hot words (tokens, customers)
TRIPLES = CONTEXTS
SINGLES = TRIPLES + 65536 * SYMBOLS
HOT = SINGLES + 7
SUMS = "part long, place binary, value binary, other binary, zipped boolean"
PART_BITS = 14


def _sum_rows(place: np.ndarray, value: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """Sums of sorted places as one row per part of 2**PART_BITS places."""
    part = place >> PART_BITS
    at = _bounds(part)
    return _row_batch([pa.array(part[at[:-1]]), *[_packs(at, x, "<i8") for x in (place, value, other)]], SUMS)


def _sums(batches):
    """Per task: tokens and tables of contexts, customers of byte triples, customers and tables of words, and hot words."""
    tokens, tables = np.zeros(CONTEXTS, np.int64), np.zeros(CONTEXTS, np.int64)
    singles = np.zeros(7, np.int64)  # words, customers, word tables, pairs once, twice, words with one customer, two
    hot = np.zeros((2, HOT_WORDS), np.int64)
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for _, b in read_buckets(batch):
            np.add.at(tokens, b.contexts, b.counts)
            np.add.at(tables, b.contexts, b.tables)
            plain = b.hot < 0
            mine = b.customers[plain]
            singles += (len(mine), mine.sum(), b.word_tables[plain].sum(), (b.counts == 1).sum(), (b.counts == 2).sum(), (mine == 1).sum(), (mine == 2).sum())
            np.add.at(hot[0], b.hot[~plain], b.sums(b.counts)[~plain])
            np.add.at(hot[1], b.hot[~plain], b.customers[~plain])
            lengths = _lengths(b.words)
            keys, back = np.unique(np.concatenate([keys, triples(b.words, lengths)]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, np.repeat(b.word_tables, lengths + 1)]), len(keys)).astype(np.int64)
    used = np.flatnonzero(tokens)
    yield _sum_rows(np.concatenate([used, keys + TRIPLES, np.arange(7) + SINGLES, np.arange(HOT_WORDS) + HOT]),
                    np.concatenate([tokens[used], counts, singles, hot[0]]),
                    np.concatenate([tables[used], np.zeros(len(keys) + 7, np.int64), hot[1]]))


def _sum_parts(batches):
    """Rows come sorted by part: the sums of all tasks."""
    part, place, values = None, None, None
    for batch in batches:
        for i, p in enumerate(batch.column("part").to_pylist()):
            get = _reader(batch, i)
            new, more = get("place", "<i8"), np.stack([get("value", "<i8"), get("other", "<i8")], axis=1)
            if p != part:
                if part is not None:
                    yield _sum_rows(place, values[:, 0], values[:, 1])
                part, place, values = p, new.copy(), more
                continue
            place, back = np.unique(np.concatenate([place, new]), return_inverse=True)
            more = np.concatenate([values, more])
            values = np.zeros((len(place), 2), np.int64)
            np.add.at(values, back, more)
    if part is not None:
        yield _sum_rows(place, values[:, 0], values[:, 1])


def _totals(state: DataFrame, layout: Layout, before: Totals | None, number: int) -> tuple[Totals, int]:
    """Totals of a state, and the number of words; at most CONTEXTS + 2**16 * SYMBOLS sums come to the driver, packed."""
    n_hot = len(layout.hot)
    found = state.mapInArrow(_sums, SUMS).repartition("part").sortWithinPartitions("part").mapInArrow(_sum_parts, SUMS).toArrow()
    rows = [tuple(get(c, "<i8") for c in ("place", "value", "other")) for batch in found.to_batches() for get in (_reader(batch, i) for i in range(len(batch)))]
    place, value, other = (np.concatenate(x) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 3

    def dense(first: int, size: int, values: np.ndarray = value) -> np.ndarray:
        out = np.zeros(size, np.int64)
        mine = (place >= first) & (place < first + size)
        out[place[mine] - first] = values[mine]
        return out

    n_words, customers, tables, n1, n2, m1, m2 = dense(SINGLES, 7).tolist()
    mine = np.flatnonzero((place >= TRIPLES) & (place < SINGLES))
    mine = mine[np.argsort(place[mine])]
    keys, counts = place[mine] - TRIPLES, value[mine]
    hot_tokens, hot_customers = dense(HOT, n_hot), dense(HOT, n_hot, other)
    rng = np.random.default_rng([SEED, 1000 + number])
    hot_tables = np.minimum(hot_customers, 1)
    if n_hot:
        if before:
            hot_tables = seat(hot_customers, (STRENGTH + before.word_discount * before.tables) * before.spelling.words(layout.words), before.word_discount, rng)
        lengths = _lengths(layout.words)
        keys, back = np.unique(np.concatenate([keys, triples(layout.words, lengths)]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, np.repeat(hot_tables, lengths + 1)]), len(keys)).astype(np.int64)
    keys, counts = keys[counts > 0], counts[counts > 0]
    spelling = sample_spelling(keys, counts, before.spelling if before else None, rng)
    estimate = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5  # noqa: E731  from dishes that occur once and twice
    m1, m2 = m1 + int((hot_customers == 1).sum()), m2 + int((hot_customers == 2).sum())
    return Totals(dense(0, CONTEXTS), dense(0, CONTEXTS, other), customers + int(hot_customers.sum()), tables + int(hot_tables.sum()),
                  before.discount if before else estimate(n1, n2), estimate(m1, m2), spelling, hot_tokens, hot_customers, hot_tables), \
        n_words + int((hot_tokens > 0).sum())


@dataclass
class Fitted:
    path: str
    train_tokens: int
    n_words: int
    samples: list[Totals]
    layout: Layout


def held_out():
    """crc32 of the id as text divisible by 10; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 10 == 0, F.lit(False))


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))


def _written(df: DataFrame, label: str) -> str:
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return path


def fit(docs: DataFrame) -> Fitted:
    """Count the words of all training documents and sample the seatings."""
    spark = docs.sparkSession
    prepared = _prepared(docs)
    layout = plan(prepared)
    counted = prepared.filter("not held_out").mapInArrow(_count_words(layout), COUNTED)
    words = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge_words, STATE)
    path = _written(words, "seating")
    read = lambda: spark.read.schema(STATE).parquet(path)
    totals, n_words = _totals(read(), layout, None, 0)
    samples = []
    for number in range(BURN_IN + SAMPLES):
        evaluate, resample = number >= BURN_IN, number < BURN_IN + SAMPLES - 1
        if evaluate:
            samples.append(totals)
        shared = spark.sparkContext.broadcast(totals)  # contexts and byte triples: bounded
        older, path = path, _written(read().mapInArrow(_sweep(shared, number, evaluate, resample), STATE), "seating")
        remove(spark, older)
        if resample:
            totals, n_words = _totals(read(), layout, totals, number + 1)
    return Fitted(path, int(totals.context_tokens.sum()), n_words, samples, layout)


# ---------------------------------------------------------------- scores

PLACES = ("bucket long, kind int, chunk long, keys binary, hot binary, lengths binary, raw binary, n binary, docs binary, contexts binary, counts binary, "
          "seen binary, roots binary, doc_ids binary, held binary, n_tokens binary, zipped boolean")
MODEL, PLACE, DIRECTORY = 0, 1, 2  # in this order within a bucket


def _places(layout: Layout):
    """Per chunk and bucket: where its words stand (document of the chunk, context); and one row that names the documents."""
    def run(batches):
        part = TaskContext.get().partitionId()
        for number, chunk in enumerate(_chunks(batches)):
            h, context, doc, first, length = chunk.arrays()
            name = part << 32 | number
            held = np.array(chunk.held)
            keys, hot = layout.keys(h, context)
            order = np.argsort(keys, kind="stable")  # documents stay in order
            keys = keys[order]
            at = _bounds(keys)
            token = order[at[:-1]]
            outside = np.logical_or.reduceat(held[doc[order]], at[:-1])  # only these can be unknown
            lengths, raw = _spelling(np.concatenate(chunk.raw), first[token], np.where(outside, length[token], 0), (h[token] == END_HASH) & outside)
            bucket = layout.bucket(keys[at[:-1]])
            row = _bounds(bucket)
            n = len(row) - 1
            yield _row_batch(
                [pa.array(bucket[row[:-1]]), pa.array(np.full(n, PLACE, np.int32)), pa.array(np.full(n, name)), _packs(row, keys[at[:-1]], "<u8"),
                 _packs(row, hot[token], "<i2"), _packs(row, lengths, "<u4"), _packs(_starts(lengths)[row], raw, "u1"), _packs(row, np.diff(at), "<u4"),
                 _packs(at[row], doc[order], "<u2"), _packs(at[row], context[order], "u3"), *[_empty(n)] * 6], PLACES)
            sizes = np.bincount(doc, minlength=len(held))
            known = np.array([d is not None for d in chunk.doc_ids])
            ids = np.array([0 if d is None else d for d in chunk.doc_ids], "<i8")
            marks = held.astype(np.uint8) | known.astype(np.uint8) << 1
            yield _row_batch(  # dealt out like any bucket
                [pa.array([(name * 0x9E3779B97F4A7C15 + 1) % 2**63]), pa.array([DIRECTORY], pa.int32()), pa.array([name]), *[_empty(1)] * 10,
                 _one(ids, "<i8"), _one(marks, "u1"), _one(sizes, "<i8")], PLACES)

    return run


PARTS = "chunk long, docs binary, base binary, score binary, known binary, doc_ids binary, held binary, n_tokens binary"
_PART_KINDS = {"docs": "<i4", "base": "<f8", "score": "<f8", "known": "<i8"}


@dataclass
class Known:
    """What a bucket knows: its words by key, and its pairs."""

    keys: np.ndarray
    total: np.ndarray
    roots: np.ndarray
    code: np.ndarray  # word * CONTEXTS + context, sorted
    own: np.ndarray  # pair x sample

    @staticmethod
    def of(b: Bucket, model: list[Totals]) -> Known:
        own = np.column_stack([g.own(b.contexts, b.counts, b.seen[:, i]) for i, g in enumerate(model)])
        return Known(b.keys.copy(), b.sums(b.counts), b.roots.copy(), b.word() * CONTEXTS + b.contexts, own)

    @staticmethod
    def nothing(samples: int) -> Known:
        return Known(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, samples)), np.zeros(0, np.int64), np.zeros((0, samples)))


def _find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return at, sorted_values[at] == wanted


def _score_row(know: Known, model: list[Totals], hot_roots: np.ndarray, left: np.ndarray, get, tokens: int, n_words: int):
    """Document, base score, score and whether known, of each place of a row."""
    keys, hot, n = get("keys", "<u8"), get("hot", "<i2"), get("n", "<u4").astype(np.int64)
    doc, context = get("docs", "<u2").astype(np.int64), get("contexts", "u3")
    at, here = _find(know.keys, keys)
    total, root = np.zeros(len(keys), np.int64), np.zeros((len(keys), len(model)))
    total[here], root[here] = know.total[at[here]], know.roots[at[here]]
    is_hot = hot >= 0
    total[is_hot], root[is_hot] = model[-1].hot_tokens[hot[is_hot]], hot_roots[hot[is_hot]]
    scale = np.zeros(len(keys))  # logarithm of what all roots of a word are divided by, since long spellings are below any double
    strange = np.flatnonzero(total == 0)
    if len(strange):
        words = _words(get("lengths", "<u4"), get("raw", "u1")).take(pa.array(strange))
        logs = np.stack([g.log_strange(words) for g in model], axis=1)
        scale[strange] = logs.max(axis=1)
        root[strange] = np.exp(logs - scale[strange, None])
    word = np.repeat(np.arange(len(keys)), n)
    p = (left[context] * root[word]).mean(axis=1)
    pair, there = _find(know.code, at[word] * CONTEXTS + context)
    there &= here[word]
    p[there] += know.own[pair[there]].mean(axis=1)
    base = np.log10((total + 0.1) / (tokens + 0.1 * (n_words + 1)))
    return doc, base[word], np.log10(p) + scale[word] / np.log(10), total[word] > 0


def _add_up(samples, layout: Layout, tokens: int, n_words: int):
    """Sums per chunk and document over the buckets of this task."""

    def run(batches):
        model: list[Totals] = samples.value
        left = np.stack([s.left() for s in model], axis=1)  # context x sample
        hot_roots = np.zeros((len(layout.hot), len(model)))
        for i, g in enumerate(model if len(layout.hot) else ()):
            hot_roots[:, i] = g.root(g.hot_customers, g.hot_tables, g.spelling.words(layout.words))
        names = _names(PARTS)
        sums: dict[int, list[np.ndarray]] = {}
        held_rows, bucket, know = 0, None, Known.nothing(len(model))

        def flush():
            for chunk, (base, score, known, seen) in sums.items():
                docs = np.flatnonzero(seen)
                packed = [_one(x, kind) for x, kind in zip((docs, base[docs], score[docs], known[docs]), _PART_KINDS.values())]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *packed, _empty(1), _empty(1), _empty(1)], names=names)
            sums.clear()

        for batch in batches:
            for i, (b, kind, chunk) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "chunk")))):
                get = _reader(batch, i)
                if kind == DIRECTORY:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk]), *[_empty(1)] * 4, *[_one(get(c, "u1"), "u1") for c in ("doc_ids", "held", "n_tokens")]], names=names)
                    continue
                if b != bucket:
                    bucket, know = b, Known.nothing(len(model))
                if kind == MODEL:
                    n, contexts = get("n", "<u4").astype(np.int64), get("contexts", "u3")
                    none = np.zeros(0, np.int64)
                    know = Known.of(Bucket(get("keys", "<u8"), get("hot", "<i2"), None, n, contexts, get("counts", "<i8"), none, none, none,
                                           get("seen", "<i8").reshape(len(contexts), -1), get("roots", "<f8").reshape(len(n), -1)), model)
                    continue
                doc, base, score, known = _score_row(know, model, hot_roots, left, get, tokens, n_words)
                size = int(doc.max()) + 1
                have = sums.get(chunk)
                if have is None or len(have[0]) < size:
                    grown = [np.zeros(size), np.zeros(size), np.zeros(size, np.int64), np.zeros(size, bool)]
                    if have is not None:
                        for to, x in zip(grown, have):
                            to[:len(x)] = x
                    held_rows += size - (0 if have is None else len(have[0]))
                    have = sums[chunk] = grown
                n = len(have[0])
                have[0] += np.bincount(doc, base, n)
                have[1] += np.bincount(doc, score, n)
                have[2] += np.bincount(doc, known, n).astype(np.int64)
                have[3][doc] = True
                if held_rows > FLUSH_ROWS:
                    yield from flush()
                    held_rows = 0
        yield from flush()

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _per_document(batches):
    """Rows come sorted by chunk, the row that names its documents first."""
    names = _names(SCORES)

    def finish(d):
        ids, held, tokens, base, score, known = d
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(held), pa.array(tokens, pa.int64()), pa.array(known), pa.array(base), pa.array(score)], names=names)

    chunk, d = None, None
    for batch in batches:
        for i, c in enumerate(batch.column("chunk").to_pylist()):
            if c != chunk:
                if d is not None:
                    yield finish(d)
                ids, marks, sizes = (np.frombuffer(batch.column(n)[i].as_py(), k) for n, k in (("doc_ids", "<i8"), ("held", np.uint8), ("n_tokens", "<i8")))
                d = (pa.array(ids, mask=marks & 2 == 0), marks & 1 == 1, sizes, np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64))
                chunk = c
                continue
            at = np.frombuffer(batch.column("docs")[i].as_py(), _PART_KINDS["docs"])
            for k, name in ((3, "base"), (4, "score"), (5, "known")):
                d[k][at] += np.frombuffer(batch.column(name)[i].as_py(), _PART_KINDS[name])
    if d is not None:
        yield finish(d)


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    score is the log10 probability of the words and the end of the text;
    base_score that of single words with 0.1 added to each count.  A null,
    empty or blank text is its end alone.  Repeated rows stay repeated; other
    columns are left out.  Without training documents every word is unknown.
    """
    spark = docs.sparkSession
    nothing = F.lit(b"").cast("binary")
    model = spark.read.schema(STATE).parquet(fitted.path).withColumns(
        {"kind": F.lit(MODEL), "chunk": F.lit(0).cast("long"), **{c: nothing for c in ("lengths", "raw", "docs", "doc_ids", "held", "n_tokens")}}).select(*_names(PLACES))
    places = _prepared(docs).mapInArrow(_places(fitted.layout), PLACES)
    samples = spark.sparkContext.broadcast(fitted.samples)
    together = places.unionByName(model).repartition("bucket").sortWithinPartitions("bucket", "kind")
    sums = together.mapInArrow(_add_up(samples, fitted.layout, fitted.train_tokens, fitted.n_words), PARTS)
    ordered = sums.withColumn("later", F.octet_length("doc_ids") == 0).repartition("chunk").sortWithinPartitions("chunk", "later").drop("later")
    return ordered.mapInArrow(_per_document, SCORES).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(fitted.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of held-out and training documents."""
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))
