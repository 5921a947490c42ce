"""Toxicity scores: logistic regression fitted by FTRL-proximal over hashed word n-grams and skip-grams.

Features are presences of words, word pairs and pairs with one word between,
hashed to ``2**BITS`` coordinates.  Each coordinate has its own learning rate,
and the L1 term keeps every coordinate at zero whose evidence is small, so the
fitted weights are a short sparse vector of a size that the sample bounds.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from partsmith.llm.words import MARKS, Words, mix, pair, slices

BITS = 22
#: bound of the sample that is fitted: labelled documents
TRAIN_DOCS = 20_000
THRESHOLD = 0.3
_SEEDS = (np.uint64(0x51), np.uint64(0x52), np.uint64(0x53))


@dataclass(frozen=True)
class Rates:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    passes: int = 4


@dataclass(frozen=True)
class Model:
    """Sparse weights: coordinates in ascending order, their weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def _coordinates(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - BITS)).astype(np.int32)


def _grams(words: Words):
    """Coordinates of each kind of feature with the row of each; features do not reach across rows."""
    h, row = words.hash, words.row_of_word()
    yield _coordinates(h ^ _SEEDS[0]), row
    for gap in (1, 2):
        same = row[:-gap] == row[gap:]
        yield _coordinates(pair(h[:-gap] ^ _SEEDS[gap], h[gap:])[same]), row[gap:][same]


def _extract(batches):
    """Distinct coordinates of each labelled text."""
    for whole in batches:
        for batch in slices(whole):
            n = len(batch)
            parts = list(_grams(Words(batch.column("text"), MARKS)))
            key = np.unique(np.concatenate([r.astype(np.int64) << BITS | i for i, r in parts]))
            cut = np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << BITS)
            coords = (key & ((1 << BITS) - 1)).astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array([coords[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                names=["toxic", "coords"])


def ftrl(examples: list[tuple[int, np.ndarray]], rates: Rates) -> Model:
    """Passes of FTRL-proximal over (label, distinct coordinates) in the order given."""
    size = 1 << BITS
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    positive = sum(y for y, _ in examples)
    bias = float(np.log((positive + 1) / (len(examples) - positive + 19)))
    bias_n = 1.0
    for _ in range(rates.passes if positive else 0):
        for label, at in examples:
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > rates.l1, (np.sign(zi) * rates.l1 - zi) / ((rates.beta + root) / rates.alpha + rates.l2), 0)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            step = (np.sqrt(ni + g * g) - root) / rates.alpha
            z[at] = zi + g - step * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= 0.5 * g / np.sqrt(bias_n)
    index = np.flatnonzero(np.abs(z) > rates.l1)
    zi, ni = z[index], n[index]
    weight = (np.sign(zi) * rates.l1 - zi) / ((rates.beta + np.sqrt(ni)) / rates.alpha + rates.l2)
    return Model(index.astype(np.int32), weight.astype(np.float32), float(bias))


def fit(labelled: DataFrame, rates: Rates = Rates()) -> Model:
    """Fit on the rows of ``labelled`` (text, toxic), a sample bounded by :func:`labelled_rows`.

    The learner reads its examples one after the other, so the bounded sample
    goes to one task; only the sparse weights come to the driver.
    """
    coords = labelled.select(F.col("toxic").cast("int").alias("toxic"), F.col("text").cast("string").alias("text")).mapInArrow(
        _extract, "toxic int, coords binary")

    def learn(batches):
        examples = [(int(y), np.frombuffer(c, "<i4")) for b in batches for y, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        examples.sort(key=lambda e: (zlib.crc32(e[1]), e[0]))  # an order that does not follow that of the files
        model = ftrl(examples, rates)
        yield pa.RecordBatch.from_pydict({"index": np.append(model.index, -1).astype(np.int32), "weight": np.append(model.weight, model.bias).astype(np.float64)})

    found = coords.repartition(1).mapInArrow(learn, "index int, weight double").toPandas()
    if found.empty:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(1 / 19)))
    weights = found[found["index"] >= 0]
    return Model(weights["index"].to_numpy(), weights["weight"].to_numpy(np.float32), float(found.loc[found["index"] < 0, "weight"].iloc[0]))


class Scorer:
    def __init__(self, model: Model):
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[model.index] = model.weight
        self.bias = model.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text; a feature counts once however often it stands there."""
        n = len(texts)
        rows, coords = [], []
        for at, row in _grams(Words(texts, MARKS)):
            hit = np.flatnonzero(self.dense[at])
            rows.append(row[hit])
            coords.append(at[hit])
        key = np.unique(np.concatenate(rows).astype(np.int64) << BITS | np.concatenate(coords))
        total = np.bincount(key >> BITS, self.dense[key & ((1 << BITS) - 1)], n) if len(key) else np.zeros(n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1) and ``toxic_predicted`` (0 or 1) for every row.

    A null or empty text has no features and gets the score of the bias.
    Columns of ``docs`` with these two names are replaced.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # bounded: at most 2**BITS coordinates, few of them non-zero
    docs = docs.drop("toxic_score", "toxic_predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())])

    def run(batches):
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole):
                p = scorer.scores(batch.column("text"))
                out = [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "toxic_score", "toxic_predicted"])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows that never take part in fitting: crc32 of the id as text leaves 2 when divided by 4 (a null id: no)."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """key, text and toxic of the labelled rows to learn from; a document with any toxic label is toxic.

    The first ``train_docs`` labelled documents by hash of their id are taken,
    none of them held out.  Their labels are few by that bound, so they are
    sent to the texts and no text is shuffled.  Null ids, null labels and
    labels without a document are left out.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(
        F.col("doc_id").alias("key")).agg(F.max("toxic").alias("toxic"))
    sample = marks.orderBy(F.xxhash64("key"), "key").limit(train_docs)
    return docs.select(F.col("doc_id").alias("key"), "text").join(F.broadcast(sample), "key")
