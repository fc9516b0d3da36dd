"""Packing token sequences by bounded-space online best-fit.

Every task encodes its documents, cuts those longer than a sequence and places
the pieces one by one as they come: into the open bin with the least free space
that suffices, else into a new one. At most ``open_bins`` are open; a bitset, one
bit for each amount of free space, finds the best bin by its lowest set bit
from the piece's size on. When a new bin is needed and no more may be open, the
fullest one closes.

The pieces of bins still open at a task's end are packed once more, those of
a few tasks together, so that small tasks leave few bins half full.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.llm._words import map_texts, slices
from pagesift.llm.bpe import PATTERN, PLAIN, byte_alphabet
from pagesift.session import stage

CAPACITY = 1024
OPEN_BINS = 64
END_ID = 2
TASKS_A_GROUP = 16   # whose last open bins are packed together
ROWS = 20_000        # pieces in one Arrow batch


class TokenIds:
    """Ids of texts, as the tokenizers library gives them for a vocabulary file.

    If the file's merges stand in the order of their ids, ids are ranks and the
    faster encoder by ranks gives the same ids; texts with characters on which
    pattern engines may differ go to the library itself, as does all text of
    other files."""

    def __init__(self, path: str):
        import json
        import os

        import regex
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = {t: i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in special}
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"].get("merges", [])
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
        self.ranked = None
        if all(set(t) <= byte_of.keys() for t in vocab) and all(a < b for a, b in zip(merged, merged[1:])):
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, special_tokens=special,
                                            mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in vocab.items()})
        self.plain = regex.compile(PLAIN).fullmatch

    def __call__(self, text: str) -> np.ndarray:
        if self.ranked is not None and self.plain(text):
            return self.ranked.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


class Bins:
    """Open bins of one packer; ``place`` hands back the bins that it closes."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free = 0                                          # bit f: an open bin has f free
        self.stacks: list[list] = [[] for _ in range(capacity + 1)]  # open bins by free space
        self.n_open = 0

    def _take(self, free: int) -> list:
        stack = self.stacks[free]
        taken = stack.pop()
        if not stack:
            self.free ^= 1 << free
        self.n_open -= 1
        return taken

    def place(self, size: int, item) -> Iterator[list]:
        """Put an item of 1 to ``capacity`` tokens into a bin, a list of items."""
        fits = self.free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            held = self._take(left)
        else:
            left, held = self.capacity, []
            if self.n_open == self.limit and size < self.capacity:
                yield self._take((self.free & -self.free).bit_length() - 1)
        held.append(item)
        left -= size
        if not left:
            yield held
            return
        self.stacks[left].append(held)
        self.free |= 1 << left
        self.n_open += 1

    def rest(self) -> list[list]:
        """The bins that are still open, the fullest first."""
        return [held for stack in self.stacks for held in stack]


def lengths(n: int, capacity: int) -> list[int]:
    """Pieces of a document of n tokens: all full but the first."""
    full, first = divmod(n, capacity)
    return [first] * bool(first) + [capacity] * full


def placed(items: list[tuple], sequence: int | None) -> Iterator[tuple]:
    """Rows of one bin: its items laid end to end."""
    at = 0
    for item in items:
        yield *item, sequence, at
        at += item[3]


def pack(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         open_bins: int = OPEN_BINS, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Place every whole text, encoded and closed by ``end_id``, in sequences of at
    most ``capacity`` tokens.

    Returns one row per piece: (id, piece, start, length, ids_crc32, sequence_id,
    offset), and on request ``ids``. Only documents longer than a sequence are
    cut; all their pieces are full but the first.

    Defined cases: null and empty texts are the end token alone; null and
    repeated ids are passed through, each row a document of its own; an empty
    table gives no rows; other columns are ignored. A task holds a slice of
    texts, the longest text and ``open_bins`` bins of at most ``capacity`` pieces;
    the second packing holds one group of ``TASKS_A_GROUP`` times as many. Which
    documents share a sequence depends on how the rows are dealt to tasks;
    pieces do not.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    fields = f"id {id_type}, piece int, start long, length long, ids_crc32 long{', ids array<int>' * with_ids}"
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]

    def batch(rows: list[tuple], id_arrow: pa.DataType, more: list[pa.DataType], more_names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [id_arrow, *types, *more])], names + more_names)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode, bins, rows, n_bins, id_arrow = TokenIds(tokenizer_path), Bins(capacity, open_bins), [], 0, None
        more, more_names = [pa.int64(), pa.int64(), pa.int32()], ["sequence_id", "offset", "task"]
        for whole in batches:
            id_arrow = whole.schema.field("id").type
            for b in slices(whole, "text"):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    start = 0
                    for k, size in enumerate(lengths(len(ids), capacity)):
                        part = ids[start:start + size]
                        item = (doc, k, start, size, zlib.crc32(part.tobytes()), *[part.tolist()] * with_ids)
                        for closed in bins.place(size, item):
                            rows += [(*r, task) for r in placed(closed, task << 32 | n_bins)]
                            n_bins += 1
                        start += size
                if len(rows) >= ROWS:
                    yield batch(rows, id_arrow, more, more_names)
                    rows = []
        rows += [(*item, None, None, task) for held in bins.rest() for item in held]
        if rows:
            yield batch(rows, id_arrow, more, more_names)

    def second_pass(key, table: pa.Table) -> pa.Table:
        group, bins, rows, n_bins = key[0].as_py(), Bins(capacity, open_bins), [], 0
        id_arrow = table.schema.field("id").type
        # The largest first: all items are known here.
        order = np.lexsort((table["ids_crc32"].to_numpy(), table["piece"].to_numpy(), -table["length"].to_numpy()))
        for item in zip(*[table[c].take(order).to_pylist() for c in names]):
            for closed in bins.place(item[3], item):
                rows += placed(closed, -(group << 32 | n_bins) - 1)
                n_bins += 1
        for held in bins.rest():
            rows += placed(held, -(group << 32 | n_bins) - 1)
            n_bins += 1
        return pa.Table.from_batches([batch(rows, id_arrow, [pa.int64(), pa.int64()], ["sequence_id", "offset"])])

    first = stage(map_texts(source, first_pass, f"{fields}, sequence_id long, offset long, task int"), "packed")
    done = first.filter("sequence_id is not null").drop("task")
    left = first.filter("sequence_id is null").drop("sequence_id", "offset")
    left = left.withColumn("bunch", F.expr(f"cast(task div {TASKS_A_GROUP} as long)")).groupBy("bunch").applyInArrow(
        lambda key, table: second_pass(key, table), f"{fields}, sequence_id long, offset long")
    return done.unionByName(left).withColumnRenamed("id", id_col)


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, from ``pack`` with
    ids. A sequence has at most ``capacity`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))
