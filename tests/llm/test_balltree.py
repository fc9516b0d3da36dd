import math

import numpy as np
from pagesift.llm import balltree, queries
from pyspark.sql import functions as F

from .edge import SF, collect


def by_hand(rows, k, is_query):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in rows:
        if is_query(i):
            s = sorted((-sum(a * b for a, b in zip(v, u)), j) for j, u in rows if j != i and len(u) == len(v))[:k]
            out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s)]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collect(df))


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in collect(spark.read.parquet(f"{SF}/embeddings.parquet"))]
    assert got(queries.op9_ball_tree_top5(spark, SF)) == by_hand(rows, 5, lambda i: i % 50 == 0)


def test_many_small_shards_and_blocks_with_ties(spark):
    rnd = np.random.default_rng(0)
    v = np.concatenate([rnd.normal(size=(150, 6)), np.repeat(rnd.normal(size=(3, 6)), 60, axis=0), np.zeros((20, 6))])
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows, block_rows in ((40, 30), (1000, 1000), (7, 500)):
        out = balltree.top_k(df, 5, is_query=F.col("vec_id") % 3 == 0, shard_rows=shard_rows, block_rows=block_rows)
        assert got(out) == by_hand(rows, 5, lambda i: i % 3 == 0)


def test_edge_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -0.25]), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]), (250, [float("inf"), 0.0]),
            (None, [1.0, 1.0]), (300, []), (350, []), (3, [1.0, 2.0, 3.0]), (400, [3.0, 2.0, 1.0]), (4, [1e7, 1e7]), (450, [-1e7, 3e6]), (5, [])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, shard int, ids string")
    assert got(balltree.top_k(df, 5, is_query=F.col("vec_id") % 50 == 0, shard_rows=2)) == by_hand(rows, 5, lambda i: i % 50 == 0)
    assert got(balltree.top_k(df.filter("false"), 5)) == []
    assert got(balltree.top_k(df.filter("vec_id = 0"), 5)) == []


def test_repeated_rows_are_candidates_each(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [3.0]), (2, [3.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    out = got(balltree.top_k(df, 2, is_query=F.col("vec_id") == 1))
    assert out == [(1, 1, 2, 256 * 768), (1, 2, 2, 256 * 768)]


def test_bound_holds_and_prunes():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(20, 16)) * 100
    x = np.concatenate([c + rnd.normal(size=(50, 16)) for c in centres]).astype(np.int64)
    tree = balltree.BallTree(np.arange(1000), x)
    q = x[::100]
    for n, (lo, hi, *_) in enumerate(tree.nodes):
        s = q @ tree.points[lo:hi].T
        bound = q @ tree.centres[n] + np.sqrt((q.astype(float) ** 2).sum(1)) * tree.radii[n]
        assert (s.max(axis=1) <= bound + 1e-6).all()
    best = balltree.Best(np.arange(0, 1000, 100), 5, np.full(10, -np.inf))
    seen = []
    best.offer = lambda rows, scores, ids, f=best.offer: (seen.append(scores.size), f(rows, scores, ids))
    tree.search(best, q)
    assert sum(seen) < 0.6 * len(q) * len(x)
