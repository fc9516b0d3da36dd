"""Vectorised words and polynomial (Rabin-Karp) hashes over Arrow text batches.

A word is a maximal run of bytes other than space and 0x09-0x0D, so the UTF-8
bytes can be scanned without decoding. All functions are plain numpy helpers
that run inside Spark tasks on slices of one Arrow batch; a slice holds whole
texts and about ``SLICE_BYTES`` bytes, so memory follows the longest text.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pagesift.session import limit_batches

SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xD6E8FEB86659FD93 | 1


class Words(NamedTuple):
    data: np.ndarray    # the bytes of the slice (lower-cased if asked)
    offsets: np.ndarray  # byte offsets of the texts, len = texts + 1
    start: np.ndarray   # first byte of each word
    end: np.ndarray     # one past the last byte of each word
    doc: np.ndarray     # text index of each word
    first: np.ndarray   # first word of each text, len = texts + 1


def map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches of at most ``BATCH_ROWS`` texts."""
    limit_batches(df.sparkSession, BATCH_ROWS)
    return df.mapInArrow(run, schema)


def flat(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null texts count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    arr = pc.fill_null(arr, "") if arr.null_count else arr
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of a batch with about ``limit`` text bytes each."""
    arr = batch.column(column)
    _, off = flat(arr)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(arr, lower: bool = False) -> Words:
    data, off = flat(arr)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty_like(ink)
    after = np.empty_like(ink)
    if len(ink):
        before[0], before[1:] = False, ink[:-1]
        after[-1], after[:-1] = False, ink[1:]
        full = off[1:] > off[:-1]
        before[off[:-1][full]] = False
        after[off[1:][full] - 1] = False
    start = np.flatnonzero(ink & ~before)
    end = np.flatnonzero(ink & ~after) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    first = np.searchsorted(doc, np.arange(len(off)), side="left")
    return Words(data, off, start, end, doc, first)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            full = np.full(n, self.base, np.uint64)
            full[0] = 1
            self.up = np.cumprod(full, dtype=np.uint64)
            full[1:] = self.inverse
            self.down = np.cumprod(full, dtype=np.uint64)
        return self.up, self.down


class Roller:
    """Hashes of words, and of runs of words, by prefix sums of a polynomial."""

    def __init__(self):
        self.bytes, self.runs = Powers(BASE), Powers(WORD_BASE)
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

    def word_hashes(self, w: Words) -> np.ndarray:
        up, down = self.bytes.get(len(w.data) + 1)
        sums = np.zeros(len(w.data) + 1, np.uint64)
        np.cumsum(self.table[w.data] * up[:len(w.data)], out=sums[1:])
        return mix((sums[w.end] - sums[w.start]) * down[w.start] + (w.end - w.start).astype(np.uint64))

    def run_hashes(self, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of the words h[lo:hi] for each pair of bounds."""
        up, down = self.runs.get(len(h) + 1)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[:len(h)], out=sums[1:])
        return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def word_at(w: Words, k: int) -> bytes:
    return w.data[w.start[k]:w.end[k]].tobytes()


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def take_texts(arr) -> list[str]:
    """Python strings of a column, nulls as empty."""
    return ["" if t is None else t for t in arr.to_pylist()]
