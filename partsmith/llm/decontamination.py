"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are lower-cased runs of letters and digits, so marks and line breaks do
not hide a copy.  Seeds are pairs of words, next to each other or with one word
between, in the item as in the document.  An alignment of m matches and e
errors scores 2m - e; if that is at least 2tL (L words, t the least score), at
most m - tL of the m - 1 gaps between its matches hold two errors or more, and
each of the others, tL - 1 at least, is a seed in common, whatever was put in,
left out or replaced.  So of any set of an item's seeds that leaves out k of
them, tL - 1 - k at least are in common: the seeds that would cost the most
rows are left out, two thirds of what the law allows, and a place is aligned if
it has as many of the others as the law demands.

All pairs of the documents pass a bitmap of the benchmark's seeds (of fixed
size, so it can be sent to every task); what passes is joined exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from partsmith.llm.keys import doc_key
from partsmith.llm.words import MARKS, Words, pair, shingles, slices
from partsmith.session import stage

#: items below are found only as whole texts
LEAST_WORDS = 3
#: part of the best possible alignment score from which a document counts as contaminated
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BITMAP_BITS = 24


def _item_words(batches):
    for batch in batches:
        w = Words(batch.column("text"), MARKS)
        words = [w.hash[a:b].view(np.int64) for a, b in zip(w.row_at[:-1], w.row_at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])


def _item_seeds(batches):
    """Pairs of words at distance 1 and 2; of items below LEAST_WORDS the whole."""
    for batch in batches:
        keys, at, grams = [], [], []
        for key, words in zip(batch.column("item_key").to_pylist(), batch.column("words").to_pylist()):
            h = np.array(words, np.int64).view(np.uint64)
            found = [~shingles(h, LEAST_WORDS)] if len(h) < LEAST_WORDS else [pair(h[:-1], h[1:]), pair(h[:-2], h[2:])]
            for gram in found:
                keys += [key] * len(gram)
                at += range(len(gram))
                grams.append(gram.view(np.int64))
        flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at, pa.int64()), pa.array(flat)],
                                         names=["item_key", "item_at", "gram"])


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Bits of the grams' low ends, at most 2**(BITMAP_BITS - 6) rows."""
    place = F.col("gram").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    rows = grams.groupBy(F.shiftright(place, 6).alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int((gram & {(1 << BITMAP_BITS) - 1}) & 63))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _hits(bitmap):
    mask = np.uint64((1 << BITMAP_BITS) - 1)

    def run(batches):
        known = bitmap.value
        for whole in batches:
            for batch in slices(whole):
                w = Words(batch.column("text"), MARKS)
                h, row = w.hash, w.row_of_word()
                counts = np.diff(w.row_at)
                short = np.flatnonzero((counts > 0) & (counts < LEAST_WORDS))
                # texts of fewer words also as a whole, turned over so that no pair equals it
                streams = [(w.row_at[i:i + 1], ~shingles(h[w.row_at[i]:w.row_at[i + 1]], LEAST_WORDS)) for i in short]
                for step in (1, 2):
                    place = np.flatnonzero(row[:-step] == row[step:])
                    streams.append((place, pair(h[place], h[place + step])))
                hit = [known[(gram & mask).astype(np.int64)] for _, gram in streams]
                places = [place[found] for (place, _), found in zip(streams, hit)]
                grams = [gram[found] for (_, gram), found in zip(streams, hit)]
                place, gram = np.concatenate(places), np.concatenate(grams)
                keys = batch.column("doc_key").to_numpy()[row[place]] if len(place) else np.zeros(0, np.int64)
                at = place - w.row_at[row[place]] if len(place) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gram.view(np.int64)), pa.array(at, pa.int64())],
                                                 names=["doc_key", "gram", "at"])

    return run


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the place in ``words`` where it ends."""
    columns = np.arange(len(words) + 1, dtype=np.int32)
    row, best, end = np.zeros(len(words) + 1, np.int32), 0, 0
    for word in item:
        new = np.zeros_like(row)
        np.maximum(row[:-1] + np.where(words == word, MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        row = (np.maximum.accumulate(new - GAP * columns) + GAP * columns).astype(np.int32)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def _drift(length: int, least: float) -> int:
    """Most errors of an alignment, so the most its diagonals can differ."""
    return max(1, int(2 * length * (1 - least) + 1e-9))


def _score(least: float):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                w = Words(batch.column("text"), MARKS)
                out = {k: [] for k in ("doc_key", "item_id", "score", "first_word", "last_word")}
                for key, places, a, b in zip(batch.column("doc_key").to_pylist(), batch.column("places").to_pylist(), w.row_at[:-1], w.row_at[1:]):
                    words = w.hash[a:b].view(np.int64)
                    for place in places:
                        item = np.array(place["words"], np.int64)
                        slack = _drift(len(item), least) + 1
                        begin = max(0, place["low"] - slack)
                        part = words[begin:place["high"] + len(item) + slack]
                        best, end = align(item, part)
                        if best >= least * MATCH * len(item):
                            _, back = align(item[::-1], part[:end][::-1])
                            for k, v in zip(out, (key, place["item_id"], best / (MATCH * len(item)), begin + end - back, begin + end - 1)):
                                out[k].append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_key"], pa.int64()), pa.array(out["item_id"], pa.int64()), pa.array(out["score"], pa.float64()),
                     pa.array(out["first_word"], pa.int64()), pa.array(out["last_word"], pa.int64())], names=list(out))

    return run


def _places(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """Places with enough seeds, on two grids of diagonals: those of one alignment share a cell of one grid."""
    cell = F.col("cell")
    near = hits.join(seeds, "gram").withColumn("diagonal", F.col("at") - F.col("item_at"))
    near = near.withColumn("place", F.explode(F.array(
        F.floor(F.col("diagonal") / cell) * 2, F.floor((F.col("diagonal") + cell / 2) / cell) * 2 + 1)))
    places = near.groupBy("doc_key", "item_key", "place").agg(
        F.count("*").alias("n"), F.first("needed").alias("needed"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    return places.filter("n >= needed").select("doc_key", "item_key", "low", "high").distinct()


def _leaks(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    spark = docs.sparkSession
    keyed = docs.select(doc_key().alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _item_words, "item_id long, words array<long>").filter(F.size("words") > 0).distinct()
    items = stage(items.withColumn("item_key", F.monotonically_increasing_id()), "items")
    grams = stage(items.select("item_key", "words").mapInArrow(_item_seeds, "item_key long, item_at long, gram long"), "grams")
    bitmap = spark.sparkContext.broadcast(_bitmap(grams))  # 2**BITMAP_BITS flags, whatever the benchmark's size

    held = grams.groupBy("gram").agg(F.count("*").alias("held"))
    hits = keyed.select("doc_key", "text").filter("text is not null").mapInArrow(_hits(bitmap), "doc_key long, gram long, at long")
    hits = stage(hits.join(held.select("gram"), "gram"), "seeds")
    rows = hits.groupBy("gram").agg(F.count("*").alias("n")).join(held, "gram").select("gram", (F.col("n") * F.col("held")).alias("rows"))

    # in common at least: ceil(tL) - 1; left out: two thirds of these; left to find: the others
    length, drift = F.col("length"), F.floor(2 * F.col("length") * (1 - least) + 1e-9)
    common = F.when(length < LEAST_WORDS, 1).otherwise(F.greatest(F.lit(1), F.ceil(length * least - 1e-9) - 1))
    lengths = items.select("item_key", F.size("words").alias("length")).select(
        "item_key", common.alias("common"), F.floor((common + 2) / 3).alias("needed"), (2 * F.greatest(F.lit(1), drift)).alias("cell"))
    costly_first = Window.partitionBy("item_key").orderBy(F.col("rows").desc_nulls_last(), "item_at", "gram")
    seeds = grams.join(rows, "gram", "left").withColumn("place", F.row_number().over(costly_first)).join(lengths, "item_key").where(
        "rows is not null and place > common - needed").select("gram", "item_key", "item_at", "needed", "cell")

    places = _places(hits, seeds)
    of_doc = places.join(items, "item_key").groupBy("doc_key").agg(
        F.collect_list(F.struct("item_id", "words", "low", "high")).alias("places"))
    scored = keyed.select("doc_key", "text").join(of_doc, "doc_key").mapInArrow(
        _score(least), "doc_key long, item_id long, score double, first_word long, last_word long")
    best = scored.groupBy("doc_key", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("w"), "last_word")).alias("b"))
    return best.select("doc_key", "item_id", F.col("b.score").alias("score"), (-F.col("b.w")).alias("first_word"),
                       F.col("b.last_word").alias("last_word"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word and last_word of every benchmark item found in a document.

    score is the alignment score over that of a full copy, at least ``least``;
    the words are those of the best place, counted from 0.  Texts without
    words, null texts and items without words match nothing; an item of fewer
    than LEAST_WORDS words matches only a text of just these words.  No other
    pair is lost if ``least`` times the item's words is more than 1; note that
    half of a very short item is only two or three words.  Rows that share a doc_id are one document; rows
    without one give a null doc_id.
    """
    found = _leaks(docs, benchmark, least)
    doc_id = F.when(F.col("doc_key") < F.lit(2**62), F.col("doc_key"))
    return found.select(doc_id.alias("doc_id"), "item_id", "score", "first_word", "last_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; all columns as given."""
    found = stage(_leaks(docs, benchmark, least).select(F.col("doc_key").alias("_leak")).distinct(), "leaks")
    keyed = docs.withColumn("_doc_key", doc_key())
    return keyed.join(found, F.col("_doc_key") == F.col("_leak"), "left_anti").select(*docs.columns)
