"""Quality rules: compression bands.

Repetitive text compresses too well and random or encoded text too badly. The
zstandard ratio (compressed / raw bytes) of the whole text and of its fixed
chunks must lie in a band that depends on the length, since short text cannot
compress much. Chunks come in two sizes: large ones, which must also not need
more than coding their bytes one by one would, as random hex does, and small,
half overlapping ones for texts of every length, whose bytes must not be spread
evenly over their alphabet. The rule set also has the word-count and repeated-window base
rules that run before it.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagesift.llm._words import Roller, Words, map_texts, slices, words

CHUNK = 4096
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"


class Band(NamedTuple):
    """Limits for texts (or chunks) of at least ``size`` bytes."""
    size: int
    low: float
    high: float


# Level 3 ratios. Prose falls from about 0.95 at 100 bytes to 0.6 at 256, 0.5 at
# 1 KB and 0.35-0.45 at many KB. A low limit is about half of that: what is
# left when half of the text or more repeats. A high limit lies between prose
# and base64 text (0.76 at length; a header of some bytes adds to short ones).
WHOLE_BANDS = (Band(0, 0.0, 9.9), Band(100, 0.35, 1.20), Band(160, 0.32, 1.08), Band(256, 0.30, 0.95),
               Band(512, 0.28, 0.85), Band(1024, 0.25, 0.74), Band(4096, 0.20, 0.68), Band(32768, 0.15, 0.62))
# Chunks are all full (the last one is the last CHUNK bytes). Prose has 0.44-0.55,
# base64 0.76, half prose and half base64 0.62.
CHUNK_BANDS = (Band(CHUNK, 0.18, 0.62),)
# Random hex has 0.52, like prose, but that is more than its bytes need by their
# frequencies alone (1.02-1.05 of their entropy; prose of the test table has at
# most 0.98, words of random syllables 1.00-1.026).
MAX_OF_ENTROPY = 1.03
# A text fails by its chunks if more than this share of them is outside, or as
# many as BAD_RUN in a row.
MAX_BAD_CHUNKS = 0.15
BAD_RUN = 4


# Small chunks. Prose has 0.56-0.82 (so has CJK), base64 0.93 or more. Its bytes
# have at most 0.92 of the entropy of an even spread over the bytes that occur;
# hex, base64 and digits have at least 0.96. Shorter texts are too short to tell.
SMALL, SMALL_STEP = 256, 128
SMALL_BANDS = (Band(SMALL, 0.10, 0.88),)
MAX_EVENNESS = 0.94
MAX_BAD_SMALL = 0.15


def outside(ratio: float, size: int, bands: tuple[Band, ...]) -> bool:
    band = [b for b in bands if size >= b.size][-1]
    return not band.low <= ratio <= band.high


def bad_chunk(chunk: bytes, size: int) -> bool:
    """Whether a chunk, compressed to ``size`` bytes, is repetitive or encoded."""
    n = np.bincount(np.frombuffer(chunk, np.uint8))
    n = n[n > 0]
    entropy = float((n * np.log2(len(chunk) / n)).sum()) / 8   # bytes
    return outside(size / len(chunk), len(chunk), CHUNK_BANDS) or size > MAX_OF_ENTROPY * entropy


def small_chunks(raw: bytes, z) -> tuple[int, int]:
    """(small chunks, bad ones) of a text; the last chunk is its last bytes."""
    n = len(raw)
    if n < SMALL:
        return 0, 0
    size = SMALL
    starts = np.append(np.arange(0, n - size, SMALL_STEP), n - size)
    data, bad = np.frombuffer(raw, np.uint8), 0
    for block in np.array_split(starts, len(starts) // 2048 + 1):   # memory follows the block
        held = data[block[:, None] + np.arange(size)]
        count = np.bincount((held + 256 * np.arange(len(block))[:, None]).ravel(), minlength=256 * len(block)).reshape(-1, 256)
        entropy = np.log2(size) - (count * np.log2(np.maximum(count, 1))).sum(1) / size
        even = entropy > MAX_EVENNESS * np.log2(np.maximum((count > 0).sum(1), 2))
        for at, e in zip(block.tolist(), even.tolist()):
            bad += e or outside(len(z.compress(raw[at:at + size])) / size, size, SMALL_BANDS)
    return len(starts), bad


def verdict(raw: bytes, level: int = 3) -> tuple[float, int, int, bool, int, int]:
    """(ratio of the whole text, large chunks, bad ones, passed, small chunks, bad
    ones)."""
    import zstandard

    z = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
    if not raw:
        return 0.0, 0, 0, True, 0, 0
    ratio = len(z.compress(raw)) / len(raw)
    small, bad_small = small_chunks(raw, z)
    fits = not outside(ratio, len(raw), WHOLE_BANDS) and bad_small <= MAX_BAD_SMALL * small
    if len(raw) <= CHUNK:
        return ratio, 0, 0, fits, small, bad_small
    chunks = [raw[i:i + CHUNK] for i in range(0, len(raw) - CHUNK, CHUNK)] + [raw[-CHUNK:]]
    bad = [bad_chunk(c, len(z.compress(c))) for c in chunks]
    run = longest = 0
    for b in bad:
        run = run + 1 if b else 0
        longest = max(longest, run)
    passed = fits and sum(bad) <= MAX_BAD_CHUNKS * len(chunks) and longest < BAD_RUN
    return ratio, len(chunks), sum(bad), passed, small, bad_small


def _equal_earlier(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of (doc, key), and for each place whether it equals the one
    before and the one after. A stable sort keeps the text order."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = (k[1:] == k[:-1]) & (d[1:] == d[:-1]) if len(k) > 1 else False
    return order, same[:-1], same[1:]


def repeated_words(w: Words, h: np.ndarray, r: Roller, window: int) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    n = len(w.offsets) - 1
    if len(h) < window:
        return np.zeros(n, np.int64)
    lo = np.arange(len(h) - window + 1)
    lo = lo[w.doc[lo] == w.doc[lo + window - 1]]
    order, before, after = _equal_earlier(r.run_hashes(h, lo, lo + window), w.doc[lo])
    hit = lo[order[before | after]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n)


def duplicate_lines(w: Words, r: Roller) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    n = len(w.offsets) - 1
    data = w.data
    # Lines are the "words" of a text divided at \n alone; blank ones drop out.
    ink = data != 10
    breaks = np.flatnonzero(~ink)
    bounds = np.unique(np.concatenate([w.offsets[:-1], breaks + 1, w.offsets[1:]]))
    bounds = bounds[bounds <= len(data)]
    if len(bounds) < 2:
        return np.zeros(n, np.int64)
    lo, hi = bounds[:-1], bounds[1:].copy()
    hi = np.where((hi > lo) & (data[hi - 1] == 10), hi - 1, hi)
    lines = Words(data, w.offsets, lo, hi, np.searchsorted(w.offsets, lo, side="right") - 1, w.first)
    inked = np.searchsorted(w.start, hi) > np.searchsorted(w.start, lo)
    keys = r.word_hashes(lines)[inked]
    order, before, _ = _equal_earlier(keys, lines.doc[inked])
    return np.bincount(lines.doc[inked][order[before]], minlength=n)


def rules(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and the verdict of the compression bands for every whole text.

    Returns (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, ratio, n_chunks, n_bad_chunks, n_small, n_bad_small), one
    row per input row.

    Defined cases: null and empty texts have no words, so they fail the base
    rule of 20 words and are not kept (ratio 0); null or repeated ids are passed
    through; an empty table gives no rows; other columns are ignored. Memory per
    task follows the longest text.
    """
    fields = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, n_small long, n_bad_small long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Roller()
        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        for whole in batches:
            for b in slices(whole, b_text):
                w = words(b.column(1))
                n = b.num_rows
                h = r.word_hashes(w)
                n_words = np.bincount(w.doc, minlength=n)
                # Code points: bytes that do not continue a UTF-8 sequence.
                def per_text(mask):
                    sums = np.concatenate([[0], np.cumsum(mask)])
                    return sums[w.offsets[1:]] - sums[w.offsets[:-1]]
                space = (w.data == 32) | ((w.data >= 9) & (w.data <= 13))
                chars = per_text(((w.data & 0xC0) != 0x80) & ~space)
                symbols = per_text(symbol[w.data])
                dups = duplicate_lines(w, r)
                repeats = repeated_words(w, h, r, WINDOW)
                failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
                judged = [verdict(w.data[w.offsets[i]:w.offsets[i + 1]].tobytes()) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols, dups, repeats)),
                     pa.array(failed), pa.array([bool(j[3] and not f) for j, f in zip(judged, failed)]),
                     pa.array([j[0] for j in judged], pa.float64()), pa.array([j[1] for j in judged], pa.int64()),
                     *(pa.array([j[k] for j in judged], pa.int64()) for k in (2, 4, 5))],
                    [id_col, *(f.split()[0] for f in fields.split(", "))])

    source = df.select(id_col, text_col)
    b_text = source.columns[1]
    kind = source.schema[0].dataType.simpleString()
    return map_texts(source, run, f"`{id_col}` {kind}, {fields}")
