"""Substring dedup by Rabin-Karp hashes of fixed-length token windows.

Every window of ``window`` consecutive words gets a rolling polynomial hash. A
window is a copy if the same words also start in a document with a smaller id;
the words that such windows cover are removed, overlapping windows merging
into maximal intervals.

The windows of a corpus outnumber its bytes, so they are counted in steps that
move only those which can repeat, without losing any:

1. Each window picks an anchor: its ``gram``-word run with the smallest hash (the
   first one, on ties). Equal windows pick equal anchors, and neighbouring
   windows mostly share one; such a run of windows is a segment, with a hash of
   all its words. Segments are counted by anchor; an anchor within a single
   document id is dropped.
2. Of the rest, segments with equal hashes hold equal windows: all but those
   with the smallest id are copies as a whole.
3. What is left are the first segments of anchors that have several different
   ones. Their windows are hashed one by one and counted.

Joins are on (hash) keys with plain exchanges on both sides, so a passage
that a third of all documents share is split by the adaptive skew join, and
counts combine before they are shuffled.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm._words import Roller, as_long, map_texts, slices, words
from pagesift.session import stage


def first_minimum(g: np.ndarray, width: int) -> np.ndarray:
    """For each i, the first place of the smallest of g[i:i+width]; by doubling."""
    value, place, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        n = len(value) - step
        right = value[step:] < value[:n]
        value, place = np.where(right, value[step:], value[:n]), np.where(right, place[step:], place[:n])
        have += step
    return place


def segments(doc: np.ndarray, h: np.ndarray, roll: Roller, window: int, gram: int):
    """Runs of windows with one anchor: (first word, windows, anchor hash,
    segment hash) of each, over the words of many texts."""
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    at = np.arange(len(h) - gram + 1)
    g = roll.run_hashes(h, at, at + gram)
    anchor = first_minimum(g, window - gram + 1)
    starts = np.arange(len(h) - window + 1)
    starts = starts[doc[starts] == doc[starts + window - 1]]
    a = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(starts)))
    first = starts[lead]
    place = a[lead] - first
    whole = roll.run_hashes(h ^ np.uint64(0x5851F42D4C957F2D), first, first + count + window - 1)
    return first, count, g[a[lead]], whole ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def find_segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, fp, first, n, anchor, seg) of every segment; docs: (id, fp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for whole in batches:
            for b in slices(whole, "text"):
                w = words(b.column(2))
                first, n, anchor, seg = segments(w.doc, roll.word_hashes(w), roll, window, gram)
                row = w.doc[first]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)),
                     pa.array((first - w.first[row]).astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array(as_long(anchor)), pa.array(as_long(seg))],
                    ["id", "fp", "first", "n", "anchor", "seg"])

    return map_texts(docs, run, "id long, fp long, first int, n int, anchor long, seg long")


def find_windows(docs: DataFrame, window: int) -> DataFrame:
    """The single windows of listed segments; docs: (id, fp, text, todo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller()
        for whole in batches:
            listed = whole.filter(whole.column(3).is_valid())
            for b in slices(listed, "text"):
                w = words(b.column(2))
                h = roll.word_hashes(w)
                todo = b.column(3)
                row = np.repeat(np.arange(b.num_rows), np.diff(todo.offsets.to_numpy()))
                item = todo.flatten()
                first, n = item.field("first").to_numpy(), item.field("n").to_numpy()
                anchor = np.repeat(item.field("anchor").to_numpy(), n)
                row = np.repeat(row, n)
                at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                lo = w.first[row] + at
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(at.astype(np.int32)),
                     pa.array(anchor), pa.array(as_long(roll.run_hashes(h, lo, lo + window)))],
                    ["id", "fp", "first", "anchor", "win"])

    return map_texts(docs, run, "id long, fp long, first int, anchor long, win long")


def copied_intervals(df: DataFrame, *, window: int = 50, gram: int = 16, id_col: str = "doc_id",
                     text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs (id, fp, text), intervals (id, fp, spans)): per document the word
    intervals [lo, hi) to remove, not yet merged."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))
    seg = find_segments(docs.filter(F.col("id").isNotNull()), window, gram)
    # Written, so that the join has plain exchanges on both sides and a hot
    # anchor can be split.
    shared = stage(seg.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("anchor"), "anchors")
    seg = stage(seg.join(shared, "anchor"), "segments")
    variants = stage(seg.groupBy("anchor", "seg").agg(F.min("id").alias("owner")), "variants")
    several = stage(variants.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor"), "anchors")
    judged = seg.join(variants, ["anchor", "seg"])
    whole = judged.filter("owner < id").select("id", "fp", F.col("first").alias("lo"), (F.col("first") + F.col("n") + window - 1).alias("hi"))
    todo = (judged.filter("owner = id").join(several, "anchor").groupBy("id", "fp")
            .agg(F.collect_list(F.struct("first", "n", "anchor")).alias("todo")))
    win = stage(find_windows(docs.join(todo, ["id", "fp"], "left"), window), "windows")
    owner = stage(win.groupBy("anchor", "win").agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter("owner < last").drop("last"), "owners")
    single = win.join(owner, ["anchor", "win"]).filter("owner < id").select("id", "fp", F.col("first").alias("lo"), (F.col("first") + window).alias("hi"))
    spans = whole.unionAll(single).groupBy("id", "fp").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return docs, spans


def dedup(df: DataFrame, *, window: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text",
          with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window whose words also start in a
    document with a smaller id (judged on the input).

    Returns (id, n_words, n_removed, kept_sha256), one row per input row, and on
    request ``intervals`` (maximal removed word ranges [lo, hi)) and ``kept_text``
    (kept words joined by one space).

    Defined cases: null, empty and short texts have no window and lose
    nothing; a row with a null id neither removes nor loses anything; rows that
    repeat an id do not remove from each other; equal texts under several ids
    lose all words (of 50 or more) but under the smallest; an empty table gives
    no rows; other columns are ignored.
    """
    docs, spans = copied_intervals(df, window=window, gram=gram, id_col=id_col, text_col=text_col)
    extra = ", intervals array<struct<lo:int,hi:int>>, kept_text string" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                w = words(b.column(2))
                raw = w.data.tobytes()
                n, removed, sha, merged, kept = [], [], [], [], []
                for i, spans in enumerate(b.column(3).to_pylist()):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    cover = np.zeros(hi - lo + 1, np.int32)
                    if spans:
                        np.add.at(cover, [s["lo"] for s in spans], 1)
                        np.add.at(cover, [s["hi"] for s in spans], -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    text = b" ".join([raw[s:e] for s, e in zip(w.start[lo:hi][~gone].tolist(), w.end[lo:hi][~gone].tolist())])
                    n.append(hi - lo)
                    removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                        merged.append([{"lo": int(x), "hi": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                        kept.append(text.decode())
                columns = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
                if with_text:
                    columns += [pa.array(merged, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_words", "n_removed", "kept_sha256", *["intervals", "kept_text"] * with_text])

    return map_texts(
        docs.join(spans, ["id", "fp"], "left"), run, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string{extra}")
