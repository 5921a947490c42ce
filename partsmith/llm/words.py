"""Words of text columns as arrays: byte offsets and 64-bit hashes for a whole Arrow batch at a time.

A word is a run of bytes other than space and tab to carriage return; A-Z count
as a-z.  The hash of a word is a polynomial in random byte values modulo 2**64
with a final mix, so equal words have equal hashes everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240611)
BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]  # A-Z as a-z
MULT = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: for words without marks: every ASCII byte that is no letter or digit separates
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MAX_BATCH_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit values whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * MULT + (right ^ (right >> np.uint64(29))))


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the byte offset at which each row begins (nulls: no bytes)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: out[done:2*done] = out[:done] * MULT**done
        step = min(done, n - done)
        out[done:done + step] = out[:step] * (out[done - 1:done] * MULT)
        done += step
    return out


_POWERS = _powers(4096)


class Words:
    """Words of a batch: ``hash``, ``start`` and ``end`` (byte offsets in ``raw``), and ``row_at``,
    the index of the first word of each row with the total at the end."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE):
        global _POWERS
        raw, rows = column_bytes(texts)
        self.raw, self.rows = raw, rows
        inside = ~separators[raw]
        # a word also ends where its row ends
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = rows[:-1][rows[:-1] < rows[1:]]
        begins[firsts] = inside[firsts]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        lasts = rows[1:][rows[:-1] < rows[1:]] - 1
        ends[lasts] = inside[lasts]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.row_at = np.searchsorted(self.start, rows)
        if len(self.start) == 0:
            self.hash = np.zeros(0, np.uint64)
            return
        lengths = self.end - self.start
        longest = int(lengths.max())
        if longest > len(_POWERS):
            _POWERS = _powers(longest)
        # bytes of words only, so that spaces are not multiplied
        total = int(lengths.sum())
        first = np.cumsum(lengths) - lengths
        place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
        values = BYTE[raw[inside]] * _POWERS[place]
        self.hash = mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.row_at))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = MAX_BATCH_BYTES):
    """Cut a batch into runs of rows of about ``most`` bytes of text, so that arrays stay small; a longer row stands alone."""
    texts = batch.column(column)
    _, rows = column_bytes(texts)
    n, at = len(texts), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(rows, rows[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words of one row; the whole sequence as one where it has fewer words."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = hashes[:n - width + 1]
    for k in range(1, width):
        out = pair(out, hashes[k:n - width + 1 + k])
    return out
