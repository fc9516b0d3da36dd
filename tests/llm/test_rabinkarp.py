import hashlib
import random

import numpy as np
from pagesift.llm import queries, rabinkarp
from pagesift.llm._words import Roller

from .edge import SCHEMA, SF, WORDS, both, collect, edge


def by_hand(rows, window=50):
    first = {}
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k:k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < i:
                    gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in collect(df))


def test_query_equals_brute_force(spark):
    want = by_hand([(r["doc_id"], r["text"]) for r in collect(queries.documents(spark, SF))])
    assert got(queries.op10_window_dedup(spark, SF)) == want
    assert any(n for _, _, n, _ in want)


def test_edge_rows(spark):
    df = both(spark)
    assert got(rabinkarp.dedup(df)) == by_hand([(r["doc_id"], r["text"]) for r in collect(df)])
    e = edge(spark, clash=("id", "fp", "first", "spans", "anchor"))
    assert got(rabinkarp.dedup(e)) == by_hand([(r["doc_id"], r["text"]) for r in collect(e)])
    assert collect(rabinkarp.dedup(spark.createDataFrame([], SCHEMA))) == []


def test_random_overlaps(spark):
    rnd = random.Random(11)
    pool = [[f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(5, 90))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = [x for _ in range(rnd.randrange(0, 5)) for x in (rnd.choice(pool) if rnd.random() < 0.7 else [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30))])]
        rows.append((rnd.randrange(100), " ".join(w), "", "", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    for window, gram in ((50, 16), (20, 8), (6, 3)):
        assert got(rabinkarp.dedup(df, window=window, gram=gram)) == by_hand([(r[0], r[1]) for r in rows], window)


def test_intervals_are_maximal(spark):
    base = [f"b{i}" for i in range(200)]
    rows = [(1, " ".join(base), "", "", 0), (2, " ".join(["x"] * 3 + base[10:150] + ["y"] + base[150:200] + ["z"]), "", "", 0)]
    out = {r["doc_id"]: r for r in collect(rabinkarp.dedup(spark.createDataFrame(rows, SCHEMA), with_text=True))}
    assert [(s["lo"], s["hi"]) for s in out[2]["intervals"]] == [(3, 143), (144, 194)]
    assert out[2]["kept_text"] == "x x x y z" and out[1]["intervals"] == []


def test_first_minimum_is_the_leftmost():
    g = np.array([5, 3, 3, 9, 1, 1, 7, 2], np.uint64)
    for width in (1, 2, 3, 5, 8):
        want = [i + int(np.argmin(g[i:i + width])) for i in range(len(g) - width + 1)]
        assert rabinkarp.first_minimum(g, width).tolist() == want


def test_runs_hash_by_content():
    r, h = Roller(), np.array([4, 7, 9, 4, 7, 9, 7, 4], np.uint64)
    x = r.run_hashes(h, np.array([0, 3, 5]), np.array([3, 6, 8]))
    assert x[0] == x[1] != x[2]
