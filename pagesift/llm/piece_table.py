"""Fill-in-middle transformation by piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers
that never change: its text and the sentinels. Cutting splits the descriptor at
the place of the cut, an arrangement permutes the descriptors (sentinels among
them), the inverse permutation restores the text, and a hash reads the bytes
that the descriptors name one after the other. No text is copied but to write
the output column.

Cuts lie between units (runs of ASCII letters, or single other characters) and
are drawn from the hash of the document's id, so reruns agree.
"""

from __future__ import annotations

import hashlib
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm._words import flat, map_texts, slices

TEXT, SENTINEL = 0, 1
# The sentinels of prefix, suffix and middle, laid end to end in one buffer.
SENTINELS = (b"<P>", b"<S>", b"<M>")
# Slots: 0 prefix, 1 middle, 2 suffix, 3 to 5 their sentinels in the order above.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
BLOCK = 1 << 16


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The pieces with a boundary after ``at`` bytes (an empty piece at an end)."""
    out = []
    for i, p in enumerate(pieces):
        if at <= p.length:
            return out + [p._replace(length=at), Piece(p.buffer, p.start + at, p.length - at)] + pieces[i + 1:]
        out.append(p)
        at -= p.length
    raise ValueError("a cut behind the end")


def sentinel_pieces() -> list[Piece]:
    out, at = [], 0
    for s in SENTINELS:
        out.append(Piece(SENTINEL, at, len(s)))
        at += len(s)
    return out


def permute(pieces: list[Piece], order: tuple[int, ...]) -> list[Piece]:
    return [pieces[i] for i in order]


def inverse(order: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(int(i) for i in np.argsort(order))


def stream(pieces: list[Piece], buffers: tuple) -> Iterator[memoryview]:
    for p in pieces:
        yield buffers[p.buffer][p.start:p.start + p.length]


def digest(pieces: list[Piece], buffers: tuple) -> str:
    sha = hashlib.sha256()
    for part in stream(pieces, buffers):
        sha.update(part)
    return sha.hexdigest()


def split_output(output: memoryview | bytes, form: str) -> list[Piece]:
    """The six pieces of an arranged output, found by its sentinels in the order
    of the form. A transformed text holds none of its own, and none can arise
    where pieces meet, so each is found once."""
    raw = bytes(output)
    found, at = [], 0
    for slot in ARRANGEMENTS[form]:
        if slot < 3:
            continue
        s = SENTINELS[slot - 3]
        here = raw.index(s, at)
        if found:
            found.append(Piece(TEXT, at, here - at))
        found.append(Piece(TEXT, here, len(s)))
        at = here + len(s)
    return found + [Piece(TEXT, at, len(raw) - at)]


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Whether each byte of one text starts a unit."""
    lower = data | 32
    letter = (lower >= 97) & (lower <= 122)
    start = ~letter & ((data & 0xC0) != 0x80)
    start[:1] |= letter[:1]
    start[1:] |= letter[1:] & ~letter[:-1]
    return start


def nth_true(mask: np.ndarray, k: int) -> int:
    """Where the k-th True (from 0) stands; the length if there are not so many."""
    for lo in range(0, len(mask), BLOCK):
        block = mask[lo:lo + BLOCK]
        n = int(np.count_nonzero(block))
        if k < n:
            return lo + int(np.flatnonzero(block)[k])
        k -= n
    return len(mask)


def n_code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def arrange(data: np.ndarray, raw: memoryview, draws: tuple[int, int, int, int], share: int, spm_share: int) -> dict:
    """Form, counts and pieces of one text."""
    starts = unit_starts(data)
    n = int(np.count_nonzero(starts))
    whole = [Piece(TEXT, 0, len(raw))]
    h1, h2, h3, h4 = draws
    text = bytes(raw)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= share:
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "pieces": whole}
    form = "spm" if h4 % 100 < spm_share else "psm"
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    low, high = nth_true(starts, low), nth_true(starts, high)
    parts = cut(cut(whole, high), low)
    return {"n": n, "form": form, "prefix_chars": n_code_points(data[:low]), "middle_chars": n_code_points(data[low:high]),
            "pieces": permute(parts + sentinel_pieces(), ARRANGEMENTS[form])}


PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def draws(id_col: Column, seed: int) -> Column:
    """Four 32-bit numbers from the hash of the id (null: empty)."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transform(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 90, spm_share: int = 20,
              seed: int = 1, with_pieces: bool = False, with_output: bool = False) -> DataFrame:
    """Rearrange every whole text for fill-in-middle training.

    Returns (id, n, form, prefix_chars, middle_chars, output_sha256), one row
    per input row, and on request ``pieces`` (array of buffer, start, length in
    bytes) and ``output`` (string). ``n`` counts units, the two lengths code points.
    ``share`` of a hundred texts are rearranged, ``spm_share`` of a hundred of these
    with the suffix first.

    Defined cases: null and empty texts are plain with no unit, as are texts
    that hold a sentinel; equal ids draw the same numbers, a null id those of
    the empty string; repeated rows give repeated rows; an empty table gives no
    rows; other columns are ignored. A task holds a slice of texts, or one
    longer text and a few bytes for each of its bytes.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), draws(F.col(id_col), seed).alias("draws"))
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", *["pieces"] * with_pieces, *["output"] * with_output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentinels = memoryview(b"".join(SENTINELS))
        for whole in batches:
            for b in slices(whole, "text"):
                data, off = flat(b.column(1))
                every, drawn, rows = memoryview(data.tobytes()), b.column(2).to_pylist(), []
                for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    raw = every[lo:hi]
                    row = arrange(data[lo:hi], raw, tuple(drawn[i]), share, spm_share)
                    row["output_sha256"] = digest(row["pieces"], (raw, sentinels))
                    if with_output:
                        row["output"] = b"".join(stream(row["pieces"], (raw, sentinels)))
                    rows.append(row)
                types = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
                         "output_sha256": pa.string(), "output": pa.string()}
                columns = [b.column(0)]
                for c in names[1:]:
                    columns.append(pa.array([[q._asdict() for q in r[c]] for r in rows], PIECES) if c == "pieces"
                                   else pa.array([r[c] for r in rows], types[c]))
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = (f"id {source.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, "
              f"output_sha256 string{', pieces array<struct<buffer:int,start:long,length:long>>' * with_pieces}{', output string' * with_output}")
    return map_texts(source, run, fields).withColumnRenamed("id", id_col)


def restore(df: DataFrame, *, output_col: str = "output", form_col: str = "form", with_text: bool = False) -> DataFrame:
    """The texts rebuilt from outputs and forms alone: the columns of ``df`` but
    the output, and ``restored_sha256`` (on request ``restored``). An output is cut
    at its sentinels and its pieces go through the inverse permutation; plain
    ones (and null forms) are their own text, a null output is an empty text.
    A column of ``df`` with one of the new names is replaced."""
    new = ["restored_sha256", *["restored"] * with_text]
    kept = [c for c in df.columns if c != output_col and c not in new]
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("kept"), F.col(output_col).alias("text"),
                       F.col(form_col).alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                data, off = flat(b.column(1))
                every, sha, texts = memoryview(data.tobytes()), [], []
                for lo, hi, form in zip(off[:-1].tolist(), off[1:].tolist(), b.column(2).to_pylist()):
                    raw = every[lo:hi]
                    if form in ARRANGEMENTS:
                        pieces = permute(split_output(raw, form), inverse(ARRANGEMENTS[form]))[:3]
                    else:
                        pieces = [Piece(TEXT, 0, len(raw))]
                    sha.append(digest(pieces, (raw,)))
                    if with_text:
                        texts.append(b"".join(stream(pieces, (raw,))))
                columns = [b.column(0), pa.array(sha, pa.string())] + ([pa.array(texts, pa.string())] if with_text else [])
                yield pa.RecordBatch.from_arrays(columns, ["kept", *new])

    out = map_texts(source, run, f"kept {source.schema['kept'].dataType.simpleString()}, restored_sha256 string{', restored string' * with_text}")
    return out.select(*[F.col(f"kept.`{c}`").alias(c) for c in kept], *new)
