"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that finds what looks alike.

Tokens are runs of characters that keys are made of.  Each token is tagged as
begin, inside or outside of a secret from its shape, its neighbours and what
stands between them, and features of the whole text.  The field is fitted on a
bounded sample whose tags are the spans of the patterns, by conditional
likelihood, and decoded by Viterbi.  A token whose margin for "outside" exceeds
what two transitions can change is outside on every best path, so texts are cut
there and only the short stretches between are decoded.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from partsmith.llm.words import BYTE, MULT, column_bytes, mix, slices

# The patterns and least lengths of the kinds, in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
LEAST_ASSIGN = 12
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: documented bounds of the fitted sample: about so many texts, and so many of a text's spans, evenly spaced
TRAIN_DOCS = 6_000
TRAIN_SPANS = 64
HALF = 8
PASSES = 150
RATE, DECAY = 0.5, 1e-4
O, B, I = 0, 1, 2

_CLASS = np.zeros((4, 256), bool)  # lower, upper, digit, other key character
_CLASS[0, 97:123] = _CLASS[1, 65:91] = _CLASS[2, 48:58] = True
_CLASS[3, [ord(c) for c in "+/_-"]] = True
_KEY = _CLASS.any(axis=0)
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_GROUP = np.select([_CLASS[2], _CLASS[0] | _CLASS[1]], [2, 1], 0).astype(np.int8)
_LENGTHS = np.array([1, 4, 8, 12, 16, 20, 28, 40])
_GAPS = [b" ", b"=:", b"\"'", b"\n\t\r", b".,;!?"]
WORD_BITS = 12
#: values of each feature: shape, changes, gap before, previous shape, next shape, previous word, text
SIZES = (128, 20, 32, 129, 129, 1 << WORD_BITS, 32)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns: for assignments the value alone; code points, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(2), "assign", m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


class Tokens:
    """Tokens of a batch of texts: byte offsets, first token of each row, and the features of each token."""

    def __init__(self, texts: pa.Array):
        raw, rows = column_bytes(texts)
        self.raw, self.rows = raw, rows
        inside = _KEY[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        firsts, lasts = rows[:-1][rows[:-1] < rows[1:]], rows[1:][rows[:-1] < rows[1:]] - 1
        begins[firsts], ends[lasts] = inside[firsts], inside[lasts]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row_at = np.searchsorted(self.start, rows)
        n = len(self.start)
        self.features = np.zeros((n, len(SIZES)), np.int32)
        if not n:
            return
        length = self.end - self.start
        chars = raw[inside]
        at = np.cumsum(length) - length
        has = sum(np.logical_or.reduceat(_CLASS[c][chars], at).astype(np.int32) << c for c in range(4))
        size = np.searchsorted(_LENGTHS, length, "right") - 1
        shape = has * 8 + size
        group = _GROUP[chars]
        change = np.zeros(len(chars), np.int32)
        change[1:] = group[1:] != group[:-1]
        change[at] = 0
        changes = np.minimum(np.searchsorted([1, 2, 4, 8], np.add.reduceat(change, at), "right"), 4)
        hexes = np.logical_and.reduceat(_HEX[chars], at)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(self.row_at))
        first, last = np.ones(n, bool), np.ones(n, bool)
        first[1:] = row[1:] != row[:-1]
        last[:-1] = first[1:]
        # what stands between a token and the one before, from its last four bytes
        gap = np.zeros(n, np.int32)
        before = np.where(first, rows[row], np.roll(self.end, 1))
        for back in range(1, 5):
            place = self.start - back
            ok = place >= before
            byte = raw[np.maximum(place, 0)]
            for k, group_of in enumerate(_GAPS):
                gap |= (ok & np.isin(byte, np.frombuffer(group_of, np.uint8))).astype(np.int32) << k
        step = np.arange(len(chars)) - np.repeat(at, length)
        word = mix(np.add.reduceat(BYTE[chars] * mix(step.astype(np.uint64) * MULT), at))
        word = (word >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        odd = (has & 4).astype(bool) & (size >= 3)
        per_row = np.bincount(row, odd, len(rows) - 1)
        count = np.diff(self.row_at)
        text = np.minimum(np.searchsorted([1, 2, 4], per_row, "right"), 3) * 8 + np.minimum(np.log2(np.maximum(count, 1)).astype(np.int32) // 2, 7)
        f = self.features
        f[:, 0], f[:, 1], f[:, 2] = shape, changes * 2 + hexes + 10 * (length >= 12), gap
        f[:, 3] = np.where(first, 128, np.roll(shape, 1))
        f[:, 4] = np.where(last, 128, np.roll(shape, -1))
        f[:, 5] = np.where(first, 0, np.roll(word, 1))
        f[:, 6] = text[row]
        f += OFFSETS.astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # feature x tag
    moves: np.ndarray  # tag x tag; texts begin and end outside

    def emissions(self, features: np.ndarray) -> np.ndarray:
        out = self.weights[features[:, 0]]
        for k in range(1, features.shape[1]):
            out = out + self.weights[features[:, k]]
        return out


def fit(windows: np.ndarray, tags: np.ndarray) -> Model:
    """Conditional likelihood by gradient steps with per-weight rates; windows: n x length x features, tags: n x length.

    Tokens outside of windows are outside secrets, so windows begin and end there.
    """
    weights, moves = np.zeros((sum(SIZES), 3)), np.zeros((3, 3))
    square_w, square_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    n, length = tags.shape if len(tags) else (0, 0)
    if not n:
        weights[:, O] = 1.0
        return Model(weights.astype(np.float32), moves.astype(np.float32))
    given = np.eye(3)[tags]
    flat = windows.reshape(-1, windows.shape[2])
    for _ in range(PASSES):
        e = weights[windows].sum(axis=2)
        fwd, bwd = np.zeros((length, n, 3)), np.zeros((length, n, 3))
        fwd[0] = e[:, 0] + moves[O]
        for t in range(1, length):
            fwd[t] = e[:, t] + np.logaddexp.reduce(fwd[t - 1][:, :, None] + moves[None], axis=1)
        bwd[-1] = moves[:, O]
        for t in range(length - 2, -1, -1):
            bwd[t] = np.logaddexp.reduce(moves[None] + (e[:, t + 1] + bwd[t + 1])[:, None, :], axis=2)
        z = np.logaddexp.reduce(fwd[-1] + bwd[-1], axis=1)
        p = np.exp(fwd + bwd - z[None, :, None]).transpose(1, 0, 2)
        grad_m = np.zeros((3, 3))
        for t in range(1, length):
            joint = np.exp(fwd[t - 1][:, :, None] + moves[None] + (e[:, t] + bwd[t])[:, None, :] - z[:, None, None])
            grad_m += (given[:, t - 1, :, None] * given[:, t, None, :] - joint).sum(axis=0)
        grad_m[O] += (given[:, 0] - p[:, 0]).sum(axis=0)
        grad_m[:, O] += (given[:, -1] - p[:, -1]).sum(axis=0)
        diff = (given - p).reshape(-1, 3)
        grad_w = np.stack([sum(np.bincount(flat[:, k], diff[:, y], len(weights)) for k in range(flat.shape[1])) for y in range(3)], axis=1)
        grad_w -= DECAY * n * weights
        grad_m -= DECAY * n * moves
        square_w += grad_w**2
        square_m += grad_m**2
        weights += RATE * grad_w / np.sqrt(square_w)
        moves += RATE * grad_m / np.sqrt(square_m)
    return Model(weights.astype(np.float32), moves.astype(np.float32))


def viterbi(emissions: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of a stretch with "outside" on both sides."""
    score, back = emissions[0] + moves[O], []
    for e in emissions[1:]:
        ways = score[:, None] + moves
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e
    tag = int((score + moves[:, O]).argmax())
    out = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        out.append(tag)
    return out[::-1]


def tag(model: Model, emissions: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Best tags of all tokens of a batch; equal to Viterbi over each whole row."""
    tags = np.zeros(len(emissions), np.int8)
    reach = 2 * float(model.moves.max() - model.moves.min()) + 1e-3
    open_ = emissions[:, O] - emissions[:, 1:].max(axis=1) <= reach
    at = np.flatnonzero(open_)
    if len(at):
        row = np.searchsorted(row_at, at, "right")
        cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(row) > 0)) + 1
        for part in np.split(at, cuts):
            tags[part] = viterbi(emissions[part], model.moves)
    return tags


def _begins(raw: np.ndarray) -> np.ndarray:
    """The byte offset of each code point of UTF-8, and the length at the end."""
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def _apart(found: list[tuple[int, str, int]], spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Those of ``found`` that overlap none of ``spans``, which are sorted; one search each, however many there are."""
    starts, upto = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max, initial=0))
    return [f for f in found if upto[bisect_left(starts, f[2])] <= f[0]]


def _windows(batches):
    """Windows around each secret of a text, with and without the word before it, and around the token in the middle of every text."""
    width = 2 * HALF + 1
    for whole in batches:
        for batch in slices(whole):
            tokens = Tokens(batch.column("text"))
            out_f, out_t = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                a, b = int(tokens.row_at[i]), int(tokens.row_at[i + 1])
                if b - a < width:
                    continue
                tags, origin = np.zeros(b - a, np.int8), int(tokens.rows[i])
                start, end = tokens.start[a:b] - origin, tokens.end[a:b] - origin
                begins, spans = _begins(tokens.raw[origin:int(tokens.rows[i + 1])]), base_spans(text)
                lows = np.searchsorted(end, begins[[s for s, _, _ in spans]], "right") if spans else []
                highs = np.searchsorted(start, begins[[e for _, _, e in spans]]) if spans else []
                centers = []
                for low, high in zip(lows, highs):
                    if low < high:
                        hit = tags[low:high]
                        hit[hit == O] = I
                        hit[0] = B
                        centers.append(int(low))
                for c in [(b - a) // 2, *centers[::-(-len(centers) // TRAIN_SPANS) or 1]]:
                    at = min(max(0, c - HALF), b - a - width)
                    features, mine = tokens.features[a + at:a + at + width], tags[at:at + width]
                    out_f.append(features.tobytes())
                    out_t.append(mine.tobytes())
                    if mine.any():  # again without the words before it, so that shapes count by themselves
                        bare = features.copy()
                        bare[mine > 0, 2], bare[mine > 0, 5] = OFFSETS[2] + 1, OFFSETS[5]
                        out_f.append(bare.tobytes())
                        out_t.append(mine.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_f, pa.binary()), pa.array(out_t, pa.binary())], names=["features", "tags"])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on about ``train_docs`` texts, taken by hash; only windows go to the fitting task, only weights to the driver."""
    n = docs.count()
    share = min(1.0, train_docs / n) if n else 1.0
    some = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    if share < 1:
        some = some.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))
    windows = some.mapInArrow(_windows, "features binary, tags binary")
    width = 2 * HALF + 1

    def learn(batches):
        f, t = [], []
        for b in batches:
            f += b.column("features").to_pylist()
            t += b.column("tags").to_pylist()
        order = sorted(range(len(f)), key=lambda i: (f[i], t[i]))
        x = np.frombuffer(b"".join(f[i] for i in order), np.int32).reshape(-1, width, len(SIZES))
        y = np.frombuffer(b"".join(t[i] for i in order), np.int8).reshape(-1, width)
        model = fit(x, y)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "moves": [model.moves.tobytes()]})

    found = windows.repartition(1).mapInArrow(learn, "weights binary, moves binary").collect()
    if not found:
        return fit(np.zeros((0, width, len(SIZES)), np.int32), np.zeros((0, width), np.int8))
    return Model(np.frombuffer(found[0]["weights"], np.float32).reshape(-1, 3), np.frombuffer(found[0]["moves"], np.float32).reshape(3, 3))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end in code points) of every row, by start and then kind.

    Kinds assign, access and hex are the patterns' spans; crf are stretches
    tagged by the field that overlap none of them.  Null and empty texts have
    no spans; repeated rows stay repeated; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights, whatever the data

    def run(batches):
        field = shared.value
        for whole in batches:
            for batch in slices(whole):
                tokens = Tokens(batch.column("text"))
                tags = tag(field, field.emissions(tokens.features), tokens.row_at)
                tagged = np.flatnonzero(tags)
                row = np.searchsorted(tokens.row_at, tagged, "right") - 1
                extra = {}
                for t, r in zip(tagged.tolist(), row.tolist()):
                    mine, origin = extra.setdefault(r, []), int(tokens.rows[r])
                    a, b = int(tokens.start[t]) - origin, int(tokens.end[t]) - origin
                    if tags[t] == I and mine and mine[-1][2] == t - 1:
                        mine[-1] = (mine[-1][0], b, t)
                    else:
                        mine.append((a, b, t))
                out = []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    spans = base_spans(text) if text else []
                    if i in extra:
                        begins = _begins(tokens.raw[int(tokens.rows[i]):int(tokens.rows[i + 1])])
                        at = np.searchsorted(begins, [(a, b) for a, b, _ in extra[i]]).tolist()
                        spans = sorted(spans + _apart([(a, "crf", b) for a, b in at], spans), key=lambda s: (s[0], KINDS.index(s[1])))
                    out.append([{"kind": k, "start": a, "end": b} for a, k, b in spans])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def report(found: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the patterns' spans, and all spans as text."""
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("crf"),
                        F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
