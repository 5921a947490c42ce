"""Line de-duplication by content-defined chunks.

A text is cut into words, and words of more than ``LONG`` bytes (keys, scripts
without spaces) into pieces at characters that a hash of the bytes before
chooses.  A rolling hash over the last ``WINDOW`` words gives each place a rank;
places where a line begins (after a line break, or a punctuation mark and space,
because pasted passages share lines with prose) rank before all others.  A chunk
begins where the rank is the least among ``REACH`` places on both sides, so
chunks of many words cannot be missed for want of marks, an insertion moves no
boundary but those beside it, and a passage of about 50 words holds a whole
chunk nearly always.  Stretches without such a place (one word over and over)
are cut by number.  A chunk of at least ``MIN_LINES`` lines and ``MIN_WORDS``
words, or of ``ENOUGH_WORDS`` words on any number of lines, that occurs more than
once in the table stays only where it comes first (smallest doc_id, then earliest
in the text), after its bytes were compared with those of the first place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from partsmith.llm.keys import doc_key
from partsmith.llm.words import SPACE, column_bytes, mix, slices
from partsmith.session import stage

WINDOW = 2
MIN_LINES, MIN_WORDS, ENOUGH_WORDS = 2, 8, 9
#: a chunk begins at the least of so many places before and after
REACH = ENOUGH_WORDS - 1
#: stretches of more than so many words are cut after each STEP_WORDS
MOST_WORDS, STEP_WORDS = 32, 16
#: bytes from which a word is cut, and bytes of it that count as a word
LONG, PER_WORD = 32, 6
PER_PLACE = 500
MOST_OFTEN = 1024  # a chunk with this part of all repeated places is salted, one salt for each such part
_RNG = np.random.default_rng(4242)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = mix(np.arange(1, 4097, dtype=np.uint64) * _STEP) | np.uint64(1)


def _run_hash(values: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """Hash of each run of 64-bit values; order counts."""
    lengths = np.diff(np.append(starts, total))
    place = np.arange(total, dtype=np.int64) - np.repeat(starts, lengths)
    scaled = values * _FACTORS[place % len(_FACTORS)]
    far = np.flatnonzero(place >= len(_FACTORS))
    if len(far):  # the factors come again, each time multiplied by another odd number
        scaled[far] *= mix((place[far] // len(_FACTORS)).astype(np.uint64)) | np.uint64(1)
    return mix(np.add.reduceat(scaled, starts) + lengths.astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from each place on."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[:-step] = np.minimum(out[:-step], out[step:])
        done += step
    return out


def _inner(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places inside long words where a piece begins: one character in two of three bytes and more, one in eight of others."""
    at = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = at[(at - np.repeat(starts, lengths) >= 4) & (raw[at] & 0xC0 != 0x80) & ~SPACE[raw[at]]]
    seen = sum(_BYTE[raw[at - k]] * np.uint64(2 * k + 1) for k in range(4))
    return at[mix(seen) % np.where(raw[at] >= 0xE0, 2, 8).astype(np.uint64) == 0]


class Chunks:
    """Chunks of a batch: ``start`` and ``end`` (byte offsets in ``raw``), ``hash``, ``whole`` (long enough to be removed) and
    ``row_at`` (index of the first chunk of each row, the total at the end)."""

    def __init__(self, texts: pa.Array):
        raw, rows = column_bytes(texts)
        self.raw, self.rows = raw, rows
        n = len(raw)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.whole = np.zeros(0, np.uint64), np.zeros(0, bool)
            self.row_at = np.zeros(len(rows), np.int64)
            return
        firsts = rows[:-1][rows[:-1] < rows[1:]]
        inside = ~SPACE[raw]
        word = inside.copy()
        word[1:] &= ~inside[:-1]
        word[firsts] = inside[firsts]
        begins = word.copy()
        begins[firsts] = True
        units = np.flatnonzero(begins)
        lengths = np.diff(np.append(units, n))
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            begins[_inner(raw, units[long], lengths[long])] = True
            within = np.zeros(n, bool)
            within[np.repeat(units[long], lengths[long]) + np.arange(lengths[long].sum())
                   - np.repeat(np.cumsum(lengths[long]) - lengths[long], lengths[long])] = True
            within &= inside
            units = np.flatnonzero(begins)
        total = len(units)
        unit_hash = _run_hash(_BYTE[raw], units, n)
        first = np.zeros(total, bool)  # unit at the beginning of its row
        first[np.searchsorted(units, firsts)] = True
        breaks = np.zeros(n, bool)
        breaks[1:] = raw[:-1] == 10
        breaks[2:] |= (raw[1:-1] == 32) & _MARK[raw[:-2]]
        line = np.zeros(total + 1, bool)
        line[np.searchsorted(units, np.flatnonzero(breaks))] = True
        line[:-1] |= first
        opens = self._opens(unit_hash, first, line[:-1])
        self.start = units[opens]
        self.end = np.append(self.start[1:], n)
        self.hash = _run_hash(unit_hash, opens, total)
        words = np.add.reduceat(word.astype(np.int32), self.start)
        if len(long):
            words = np.maximum(words, np.add.reduceat(within.astype(np.int32), self.start) // PER_WORD)
        lines = np.add.reduceat(line[:-1].astype(np.int32), opens) + ~line[opens]
        self.whole = (words >= ENOUGH_WORDS) | (words >= MIN_WORDS) & (lines >= MIN_LINES)
        self.row_at = np.searchsorted(self.start, rows)

    @staticmethod
    def _opens(unit_hash: np.ndarray, first: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Index of the first unit of each chunk; ``first`` and ``line``: units at the beginning of a row and of a line."""
        total = len(unit_hash)
        rolled, earlier = np.zeros(total, np.uint64), unit_hash
        for k in range(1, WINDOW + 1):  # of the units before, as far as the row has them
            earlier = np.where(first, np.uint64(0), np.roll(earlier, 1))
            rolled += earlier * np.uint64(2 * k + 1) * _STEP
        top = np.uint64(1 << 63)
        rank = mix(rolled) >> np.uint64(1) | top
        rank[line] &= ~top
        rank[first] = np.uint64(2**64 - 1)
        place = np.arange(total) + np.cumsum(first) * REACH  # rows stand apart
        padded = np.full(int(place[-1]) + REACH + 1, 2**64 - 1, np.uint64)
        padded[place] = rank
        least = _least(padded, REACH)
        opens = np.flatnonzero(first | (rank < least[place - REACH]) & (rank <= least[place + 1]))
        gaps = np.diff(np.append(opens, total))
        more = np.where(gaps > MOST_WORDS, (gaps - MIN_WORDS) // STEP_WORDS, 0)
        if more.any():
            number = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
            opens = np.sort(np.append(opens, np.repeat(opens, more) + number * STEP_WORDS))
        return opens


def _emit(batches):
    for whole in batches:
        for batch in slices(whole):
            c = Chunks(batch.column("text"))
            row = np.repeat(np.arange(len(batch)), np.diff(c.row_at))[c.whole]
            keys = batch.column("doc_key").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c.hash[c.whole].view(np.int64))], names=["doc_key", "hash"])


_PIECES = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("piece", T.BinaryType())]))
_ARROW_PIECES = pa.list_(pa.struct([("at", pa.int64()), ("hash", pa.int64()), ("piece", pa.binary())]))


def _cut(names: list[str]):
    """Take out the repeated chunks that come first elsewhere; pieces of the first places are passed on with at = -1."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                c = Chunks(batch.column("text"))
                raw = c.raw.tobytes()
                keys = batch.column("doc_key").to_pylist()
                hashes, firsts = batch.column("hashes").to_pylist(), batch.column("firsts").to_pylist()
                texts, pieces = [], []
                for i, key in enumerate(keys):
                    if not hashes[i]:
                        texts.append(batch.column("text")[i].as_py())
                        pieces.append([])
                        continue
                    of, seen, kept, out = dict(zip(hashes[i], firsts[i])), set(), [], []
                    begin = int(c.rows[i])
                    for k in range(c.row_at[i], c.row_at[i + 1]):
                        a, b = int(c.start[k]), int(c.end[k])
                        h = int(c.hash[k].view(np.int64))
                        first = of.get(h) if c.whole[k] else None
                        if first is None:
                            kept.append(raw[a:b])
                        elif first == key and h not in seen:
                            seen.add(h)
                            kept.append(raw[a:b])
                            out.append({"at": -1, "hash": h, "piece": raw[a:b]})
                        else:
                            out.append({"at": a - begin, "hash": h, "piece": raw[a:b]})
                    texts.append(b"".join(kept).decode())
                    pieces.append(out)
                columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("doc_key"), pa.array(pieces, _ARROW_PIECES)],
                                                 names=[*names, "doc_key", "pieces"])

    return run


def _unequal(batches):
    """Pieces that differ from the first of their hash; rows come sorted by hash and salt, the first place before others."""
    held, at = None, None
    for batch in batches:
        keys, hashes = [], []
        for h, salt, place, key, piece in zip(*(batch.column(c).to_pylist() for c in ("hash", "salt", "at", "doc_key", "piece"))):
            if place == -1:
                held, at = piece, (h, salt)
            elif at == (h, salt) and piece != held:
                keys.append(key), hashes.append(h)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], names=["doc_key", "hash"])


def _restore(names: list[str]):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, (pieces, wrong) in enumerate(zip(batch.column("pieces").to_pylist(), batch.column("wrong").to_pylist())):
                if wrong:
                    texts[i] = put_back(texts[i], pieces, set(wrong))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return run


def put_back(text: str, pieces: list[dict], wrong: set[int]) -> str:
    """``text`` with the removed pieces of some hashes at their places again."""
    raw, out, at = text.encode(), [], 0
    position = 0  # in the text as it was
    for p in sorted((p for p in pieces if p["at"] >= 0), key=lambda p: p["at"]):
        step = p["at"] - position
        out.append(raw[at:at + step])
        at, position = at + step, p["at"] + len(p["piece"])
        if p["hash"] in wrong:
            out.append(p["piece"])
    return b"".join([*out, raw[at:]]).decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and ``n_removed`` chunks and ``removed_bytes`` of each row.

    All rows and columns stay (columns of the two new names are replaced).
    Null and empty texts stay as they are.  Rows that share a doc_id count as
    one place, so repeated rows stay alike; rows without doc_id come after all
    others in an order by their text.  The first place of a chunk keeps it
    once, further copies in the same text go too.
    """
    names = [c for c in docs.columns if c not in ("n_removed", "removed_bytes")]
    if dict(docs.dtypes)["text"] != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))
    plain = [f"c{i}" if n != "text" else "text" for i, n in enumerate(names)]  # no clash with columns made here
    keyed = docs.select(*[F.col(n).alias(p) for n, p in zip(names, plain)], doc_key().alias("doc_key"))

    chunks = keyed.select("doc_key", "text").filter("text is not null").mapInArrow(_emit, "doc_key long, hash long")
    first = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_key").alias("first")).filter("n > 1")
    first = stage(first.select("hash", "first", "n"), "chunks")
    # frequent chunks are salted on both sides of the join with their first places
    total = first.agg(F.sum("n")).first()[0] or 0
    often = first.filter(F.col("n") * MOST_OFTEN >= total).select("hash", F.ceil(F.col("n") * MOST_OFTEN / max(total, 1)).cast("long").alias("salts"))
    often = F.broadcast(often)  # at most MOST_OFTEN rows, since each has that share of all places
    dealt = chunks.join(often, "hash", "left").select(
        "doc_key", "hash", F.pmod(F.xxhash64("doc_key"), F.coalesce("salts", F.lit(1).cast("long"))).alias("salt"))
    firsts = first.select("hash", "first").join(often, "hash", "left").select(
        "hash", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1)).alias("salt"))
    places = dealt.join(firsts, ["hash", "salt"]).select("hash", "doc_key", "first").distinct()
    of_doc = places.groupBy("doc_key").agg(F.collect_list("hash").alias("hashes"), F.collect_list("first").alias("firsts"))

    schema = T.StructType([*keyed.select(*plain).schema.fields, T.StructField("doc_key", T.LongType()), T.StructField("pieces", _PIECES)])
    cut = stage(keyed.join(of_doc, "doc_key", "left").select(*plain, "doc_key", "hashes", "firsts").mapInArrow(_cut(plain), schema), "cut")

    # compare bytes with those of the first place; a place with many copies is salted and its bytes sent to each salt
    pieces = cut.select("doc_key", F.explode("pieces").alias("p")).select("doc_key", "p.*")
    parts = F.ceil(F.col("n") / PER_PLACE).cast("long")
    salted = pieces.join(first.select("hash", parts.alias("parts")), "hash")
    away = salted.filter("at >= 0").withColumn("salt", F.pmod(F.xxhash64("doc_key", "at"), F.col("parts")))
    home = salted.filter("at = -1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = home.unionByName(away).select("hash", "salt", "at", "doc_key", "piece")
    wrong = rows.repartition("hash", "salt").sortWithinPartitions("hash", "salt", "at").mapInArrow(_unequal, "doc_key long, hash long")
    wrong = stage(wrong.groupBy("doc_key").agg(F.collect_set("hash").alias("wrong")), "unequal")

    joined = cut.join(wrong, "doc_key", "left")
    gone = F.filter("pieces", lambda p: (p["at"] >= 0) & ~F.coalesce(F.array_contains("wrong", p["hash"]), F.lit(False)))
    counted = joined.withColumn("n_removed", F.size(gone).cast("long")).withColumn(
        "removed_bytes", F.aggregate(gone, F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p["piece"])))
    out = [*plain, "n_removed", "removed_bytes"]
    untouched = counted.filter("wrong is null").select(*out)
    if wrong.isEmpty():
        result = untouched
    else:  # unequal chunks of equal hash
        result = untouched.unionAll(counted.filter("wrong is not null").select(*out, "pieces", "wrong").mapInArrow(
            _restore(out), untouched.schema))
    return result.select(*[F.col(p).alias(n) for n, p in zip([*names, "n_removed", "removed_bytes"], out)])
