import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pagesift.llm import packing, queries

from .edge import SCHEMA, SF, both, collect, edge


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def expected_pieces(library, doc_id, text, capacity=1024):
    ids = library.encode(text or "", add_special_tokens=False).ids + [2]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids) + 1, capacity)]
    return [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def check_layout(rows, capacity=1024):
    """Sequences are gapless from 0 and hold at most ``capacity``."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pieces_equal_the_library_and_sequences_are_gapless(spark, library, path):
    df = both(spark)
    rows = collect(packing.pack(df, path))
    want = [p for r in collect(df) for p in expected_pieces(library, r["doc_id"], r["text"])]
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(map(str, found)) == sorted(map(str, want))
    used = check_layout(rows)
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert used <= least * 1.03 + 2


def test_every_kind_of_character(library, path):
    encode = packing.TokenIds(path)
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} '{chr(c)}s\n" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000)
             for lo in [*range(0, 0x3000, 64), *range(0xF900, 0x10000, 64), *range(0x1F300, 0x1FB00, 64)]]
    texts += ["", "<|endoftext|>", "x <|endoftext|><|endoftext|> y  ", "a" * 5000, "I'LL can't'd 's's"]
    for t in texts:
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def brute_bins(sizes, capacity, limit):
    """Best fit by looking at every open bin."""
    open_bins, closed = [], []
    for i, size in enumerate(sizes):
        fit = [b for b in open_bins if b[0] >= size]
        if fit:
            b = min(fit, key=lambda b: b[0])
        else:
            if len(open_bins) == limit and size < capacity:
                fullest = min(open_bins, key=lambda b: b[0])
                open_bins.remove(fullest)
                closed.append(fullest)
            b = [capacity, []]
            open_bins.append(b)
        b[0] -= size
        b[1].append(i)
        if b[0] == 0:
            open_bins.remove(b)
            closed.append(b)
    return closed, open_bins


@pytest.mark.parametrize("seed", range(12))
def test_bitset_places_like_a_scan_of_open_bins(seed):
    rng = random.Random(seed)
    capacity, limit = rng.choice([(16, 3), (100, 5), (1024, 64)])
    sizes = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(2000)]
    bins, closed = packing.Bins(capacity, limit), []
    for i, size in enumerate(sizes):
        closed += [list(b) for b in bins.place(size, (i, size))]
        assert bins.n_open == sum(map(len, bins.stacks)) <= limit
        assert bins.free == sum(1 << f for f, s in enumerate(bins.stacks) if s)
    want_closed, want_open = brute_bins(sizes, capacity, limit)

    def free(items):
        return sum(size for _, size in items)

    # Bins with equal free space are interchangeable: fills agree, in order.
    assert [free(b) for b in closed] == [capacity - b[0] for b in want_closed]
    assert sorted(free(b) for b in bins.rest()) == sorted(capacity - b[0] for b in want_open)
    items = sorted(i for b in closed + bins.rest() for i, _ in b)
    assert items == list(range(len(sizes)))


def test_edge_rows_and_sequences(spark, library, path):
    rows = collect(packing.pack(edge(spark, clash=("ids", "piece", "task")), path, capacity=50, open_bins=2, with_ids=True))
    check_layout(rows, 50)
    back = defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["piece"])):
        assert len(r["ids"]) == r["length"] and (r["length"] == 50 or r["piece"] == 0)
        back[r["doc_id"]] += r["ids"]
    assert back[1] == [2] and back[2] == [2] and back[4][-1] == 2
    assert collect(packing.pack(spark.createDataFrame([], SCHEMA), path)) == []
    packed = packing.pack(edge(spark), path, with_ids=True)
    sequences = collect(packing.assemble(packed))
    assert all(len(r["ids"]) == r["n_tokens"] <= 1024 for r in sequences)
    assert len(collect(queries.op12_best_fit_packing(spark, SF))) >= 200


def test_lost_tasks_give_the_same_rows(spark, path):
    """Placement is a function of the rows of a task alone."""
    df = both(spark).repartition(3, "source")
    a, b = (sorted(map(str, collect(packing.pack(df.sortWithinPartitions("doc_id", "text"), path)))) for _ in range(2))
    assert a == b
