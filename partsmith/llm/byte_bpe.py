"""Byte-level BPE by a rank file: encoding and decoding.

A pre-token is looked up in two tiers.  A minimal perfect hash over the
vocabulary finds pre-tokens that are tokens already; any other pre-token is a
doubly linked list of bytes whose neighbouring pairs wait in a heap by rank.
Pieces of text seen before are taken from a bounded store.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from partsmith.llm.store import Store
from partsmith.llm.words import mix

#: within such a run the pattern looks at the next character
_RUN = re.compile(r"\s\s")


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: in each level, keys that are alone at their bit are placed there, the
    others go one level down; the number of set bits before a key's bit is its slot."""

    def __init__(self, keys: np.ndarray, spread: float = 1.7):
        keys, bits, self.levels, at, level = np.asarray(keys, np.uint64), [], [], 0, 0
        while len(keys):
            size = max(64, int(len(keys) * spread))
            place = self._place(keys, level, size)
            alone = np.bincount(place, minlength=size) == 1
            bits.append(alone)
            self.levels.append((at, size))
            keys, at, level = keys[~alone[place]], at + size, level + 1
        self.bits = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.before = np.cumsum(self.bits) - self.bits

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x632BE59BD9B4E019 * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; some slot or -1 for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (at, size) in enumerate(self.levels):
            place = at + self._place(keys[left], level, size)
            here = self.bits[place]
            out[left[here]] = self.before[place[here]]
            left = left[~here]
        return out


class Vocabulary:
    """Ranks of a rank file with the perfect hash over its tokens and the rank of every pair that can be merged."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        tokens = list(self.ranks)
        keys = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
        self.hash = PerfectHash(keys)
        self.at_slot: list = [None] * len(tokens)
        for token, slot in zip(tokens, self.hash.slots(keys)):
            self.at_slot[slot] = (token, self.ranks[token])
        self.byte_rank = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        self.pair_rank = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pair_rank[left << 20 | right] = rank

    def whole(self, tokens: list[bytes]) -> list[int]:
        """Rank of each pre-token that is a token, else -1."""
        slots = self.hash.slots(np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64))
        out = []
        for token, slot in zip(tokens, slots):
            found = self.at_slot[slot] if slot >= 0 else None
            out.append(found[1] if found is not None and found[0] == token else -1)
        return out

    def merge(self, token: bytes) -> list[int]:
        """Ranks of a pre-token by merging, lowest rank first and leftmost among equals."""
        byte_rank, pair_rank = self.byte_rank, self.pair_rank
        ids = [byte_rank[b] for b in token]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = pair_rank.get(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                heap.append((rank, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = pair_rank.get(rank << 20 | ids[k])
                if found is not None:
                    heapq.heappush(heap, (found, i, rank, ids[k]))
            h = before[i]
            if h >= 0:
                found = pair_rank.get(ids[h] << 20 | rank)
                if found is not None:
                    heapq.heappush(heap, (found, h, ids[h], rank))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Packed little-endian ids of texts.

    A text without two white-space characters in a row is cut before each space
    and line break: no match reaches across such a place, so each piece can be
    matched alone and kept.  Any other text is matched as a whole.
    """

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern = vocabulary(path), regex.compile(pattern)
        self.tokens = Store(self._tokens)
        self.pieces = Store(self._pieces)

    def _tokens(self, matches: list[str]) -> list[bytes]:
        raw = [m.encode() for m in matches]
        return [_pack([rank] if rank >= 0 else self.vocabulary.merge(t)) for t, rank in zip(raw, self.vocabulary.whole(raw))]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        matches = [self.pattern.findall(p if p.startswith("\n") else " " + p) for p in pieces]
        ids = iter(self.tokens.values([m for ms in matches for m in ms]))
        return [b"".join(islice(ids, len(ms))) for ms in matches]

    def encode(self, texts: list[str]) -> list[bytes]:
        heads, tails = [], []
        for text in texts:
            if _RUN.search(text):
                heads.append(self.pattern.findall(text))
                tails.append([])
            else:
                first, *rest = text.replace("\n", " \n").split(" ")
                heads.append(self.pattern.findall(first))
                tails.append(rest)
        head = iter(self.tokens.values([m for ms in heads for m in ms]))
        tail = iter(self.pieces.values([p for ps in tails for p in ps]))
        return [b"".join([*islice(head, len(h)), *islice(tail, len(t))]) for h, t in zip(heads, tails)]


@lru_cache(maxsize=1)
def encoder_of(path: str, pattern: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that its stores stay warm."""
    return Encoder(path, pattern)


class Decoder:
    def __init__(self, path: str):
        bytes_of = vocabulary(path).bytes_of
        self.table = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]

    def decode(self, ids) -> bytes:
        table = self.table
        return b"".join([table[i] for i in ids])


def _batches(batches, column: str, rows: int = 512):
    for batch in batches:
        for at in range(0, len(batch), rows):
            piece = batch.slice(at, rows)
            yield piece, piece.column(column)


def _lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids and restored of every row, null and empty texts with no ids; other columns are left out.

    restored says that decoding the ids gives back the text's bytes.  Special
    tokens' strings are ordinary text.  Repeated rows stay repeated.
    """

    def run(batches):
        encoder, decoder = encoder_of(path, pattern), Decoder(path)
        for batch, texts in _batches(batches, "text", 64):
            texts = [t or "" for t in texts.to_pylist()]
            packed = encoder.encode(texts)
            back = [decoder.decode(np.frombuffer(p, "<u4").tolist()) == t.encode() for p, t in zip(packed, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), _lists(packed), pa.array(back, pa.bool_())],
                names=["doc_id", "n_tokens", "ids", "restored"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, restored boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for; a null list has none."""

    def run(batches):
        decoder = Decoder(path)
        for batch, ids in _batches(batches, "ids"):
            raw = [decoder.decode(x or ()) for x in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every text, decode its ids again, and return the digests of both; the ids never leave their task."""

    def run(batches):
        encoder, decoder = encoder_of(path, pattern), Decoder(path)
        for batch, texts in _batches(batches, "text", 64):
            packed = encoder.encode([t or "" for t in texts.to_pylist()])
            back = [decoder.decode(np.frombuffer(p, "<u4").tolist()) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()),
                 pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                 pa.array([hashlib.sha256(b).hexdigest() for b in back])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
