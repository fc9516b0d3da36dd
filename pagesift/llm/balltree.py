"""Exact top-k inner products by ball trees, one per shard of the vectors.

Vectors are dealt over shards of bounded size. A shard's tree halves its
points along the direction of largest spread; each node keeps the centre and
radius of its ball, so ``q . centre + |q| * radius`` bounds every score below it.
A block of queries searches a tree at once: nodes come from a heap by their
bound, a node goes on with those queries only whose kth best score so far does
not exceed their bound, and leaves are scored exactly in integers.

Every query block first searches one shard; the kth scores found there are
shared with the searches of the block in all shards, which also hand theirs
from shard to shard within a task, so most nodes are cut off near the root.
"""

from __future__ import annotations

import heapq
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesift.session import stage

SHARD_ROWS = 8192
BLOCK_ROWS = 1024
LEAF = 64
GROUP = 4   # shards that a task searches one after another


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of the vectors that take part."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return (df.filter(F.col(id_col).isNotNull() & x.isNotNull() & fine)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.size(x).alias("dim"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")))


def matrix(column) -> np.ndarray:
    """A list<long> column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


class BallTree:
    """Nodes in arrays; the points of a node stand next to each other."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        x = points.astype(np.float64)
        order = np.arange(len(x))
        self.nodes = []          # (low, high, left, right), children -1 at leaves
        centres, radii = [], []

        def build(lo: int, hi: int) -> int:
            me = len(self.nodes)
            own = x[order[lo:hi]]
            centre = own.mean(axis=0)
            away = own - centre
            dist = np.sqrt((away ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(float(dist.max()))
            self.nodes.append([lo, hi, -1, -1])
            if hi - lo > LEAF and radii[me] > 0:
                axis = away[int(np.argmax(dist))]
                split = np.argsort(away @ axis, kind="stable")
                order[lo:hi] = order[lo:hi][split]
                mid = (lo + hi) // 2
                self.nodes[me][2] = build(lo, mid)
                self.nodes[me][3] = build(mid, hi)
            return me

        build(0, len(x))
        self.ids, self.points = ids[order], points[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        # Products of doubles are exact below 2**53; beyond it whole numbers are used.
        self.size = float(np.abs(points).max(initial=0))

    def search(self, best: "Best", queries: np.ndarray) -> None:
        """Improve ``best`` by the points of this tree."""
        q = queries.astype(np.float64)
        norm = np.sqrt((q ** 2).sum(axis=1))
        exact = self.size * float(np.abs(queries).max(initial=0)) * max(1, q.shape[1]) < 2.0 ** 52
        mine, points = (q, self.points.astype(np.float64)) if exact else (queries, self.points)

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            b = q[rows] @ self.centres[node] + norm[rows] * self.radii[node]
            return b + 1e-9 * (np.abs(b) + norm[rows] * (self.radii[node] + 1) + 1)  # rounding

        every = np.arange(len(q))
        first = bound(0, every)
        heap = [(-float(first.max(initial=-np.inf)), 0, every, first)]
        while heap:
            _, node, rows, limits = heapq.heappop(heap)
            go = limits >= best.kth[rows]
            rows = rows[go]
            if not len(rows):
                continue
            lo, hi, left, right = self.nodes[node]
            if left < 0:
                scores = mine[rows] @ points[lo:hi].T
                best.offer(rows, scores.astype(np.int64), self.ids[lo:hi])
                continue
            for child in (left, right):
                b = bound(child, rows)
                go = b >= best.kth[rows]
                if go.any():
                    heapq.heappush(heap, (-float(b[go].max()), child, rows[go], b[go]))


class Best:
    """The k highest scores of each query, ties to the smaller id."""

    def __init__(self, own: np.ndarray, k: int, kth: np.ndarray):
        self.own, self.k = own, k
        self.scores = [np.zeros(0, np.int64)] * len(own)
        self.ids = [np.zeros(0, np.int64)] * len(own)
        # What any k rows are known to reach.
        self.kth = kth

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.kth[rows][:, None]) & (ids[None, :] != self.own[rows][:, None])
        for i in np.flatnonzero(good.any(axis=1)):
            r = rows[i]
            s = np.concatenate([self.scores[r], scores[i, good[i]]])
            d = np.concatenate([self.ids[r], ids[good[i]]])
            top = np.lexsort((d, -s))[:self.k]
            self.scores[r], self.ids[r] = s[top], d[top]
            if len(top) == self.k:
                self.kth[r] = max(self.kth[r], float(s[top[-1]]))


TREE = "dim int, shard int, ids binary, points binary"
BLOCK = "dim int, block int, ids binary, points binary"


def packed(df: DataFrame, key: str, schema: str) -> DataFrame:
    """One row of bytes per (dim, key)."""
    def pack(t: pa.Table) -> pa.Table:
        v = matrix(t["v"]).astype(np.int64)
        return pa.table({"dim": pa.array([t["dim"][0].as_py()], pa.int32()), key: pa.array([t[key][0].as_py()], pa.int32()),
                         "ids": pa.array([t["vec_id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                         "points": pa.array([v.tobytes()], pa.binary())})

    return df.groupBy("dim", key).applyInArrow(pack, schema)


def _search(t: pa.Table, k: int) -> pa.Table:
    """Rows (dim, block, shard, qids, qpoints, ids, points, kth) of one block: one
    search each; the best scores go from shard to shard."""
    dim = t["dim"][0].as_py()
    own = np.frombuffer(t["qids"][0].as_py(), np.int64)
    queries = np.frombuffer(t["qpoints"][0].as_py(), np.int64).reshape(len(own), dim)
    kth = np.full(len(own), -np.inf)
    known = np.frombuffer(t["kth"][0].as_py() or b"", np.float64)
    kth[:len(known)] = known
    best = Best(own, k, kth)
    for i in np.argsort(t["shard"].to_numpy()).tolist():
        ids = np.frombuffer(t["ids"][i].as_py(), np.int64)
        BallTree(ids, np.frombuffer(t["points"][i].as_py(), np.int64).reshape(len(ids), dim)).search(best, queries)
    n = [len(s) for s in best.scores]
    rows = np.repeat(np.arange(len(n)), n)
    return pa.table({
        "query_id": own[rows], "row": rows.astype(np.int32), "dim": np.full(len(rows), dim, np.int32),
        "block": np.full(len(rows), t["block"][0].as_py(), np.int32),
        "vec_id": np.concatenate([*best.ids, np.zeros(0, np.int64)]), "score": np.concatenate([*best.scores, np.zeros(0, np.int64)])})


def top_k(df: DataFrame, k: int = 5, *, is_query=None, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k highest integer inner products of each query row.

    Components become floor(scale * x). Queries are the rows for which the
    column ``is_query`` (over ``id_col``; default: all) is true; candidates are all
    rows but those with the query's own id. Returns (query_id, rank, vec_id,
    score), ranks from 1, ties to the smaller vec_id; all candidates if there
    are fewer than k.

    Defined cases: vectors that are null, or hold null or non-finite
    components, and rows with a null id take no part; vectors of different
    lengths are not compared; empty vectors score 0; repeated rows are
    candidates each, and queries each; scores are exact while they fit a long;
    an empty table gives no rows; other columns are ignored.
    """
    vectors = quantised(df, id_col, vector_col, scale)
    asked = vectors if is_query is None else vectors.withColumnRenamed("vec_id", id_col).filter(is_query).withColumnRenamed(id_col, "vec_id")
    n = vectors.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, blocks = -(-n // shard_rows), max(1, -(-asked.count() // block_rows))
    # Random deals: no group grows beyond its expected size by more than a little.
    deal = lambda d, salt, parts, name: d.withColumn(name, F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(parts)).cast("int"))
    trees = stage(packed(deal(vectors, 1, shards, "shard"), "shard", TREE), "shards")
    queries = stage(packed(deal(asked, 2, blocks, "block"), "block", BLOCK), "blocks")
    queries = queries.select("dim", "block", F.col("ids").alias("qids"), F.col("points").alias("qpoints"))
    found = "query_id long, row int, dim int, block int, vec_id long, score long"
    order = ["dim", "block", "shard", "qids", "qpoints", "ids", "points", "kth"]

    # One shard for each block first: what its kth score reaches is reached.
    numbered = trees.withColumn("nth", F.row_number().over(Window.partitionBy("dim").orderBy("shard")) - 1).select("dim", "shard", "nth")
    per_dim = trees.groupBy("dim").agg(F.count(F.lit(1)).alias("shards"))
    first = (queries.join(per_dim, "dim").withColumn("nth", F.pmod("block", F.col("shards")).cast("int"))
             .join(numbered, ["dim", "nth"]).join(trees, ["dim", "shard"]).withColumn("kth", F.lit(None).cast("binary")).select(*order))
    seeds = first.groupBy("dim", "block").applyInArrow(lambda t: _search(t, k), found)
    kth = (seeds.groupBy("dim", "block", "row").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
           .select("dim", "block", "row", F.when(F.col("n") >= k, F.col("least")).alias("least")))

    def known(t: pa.Table) -> pa.Table:
        rows = t["row"].to_numpy()
        least = t["least"].to_numpy(zero_copy_only=False).astype(float)
        out = np.full(int(rows.max()) + 1, -np.inf)
        out[rows] = np.where(np.isnan(least), -np.inf, least)
        return pa.table({"dim": t["dim"].slice(0, 1), "block": t["block"].slice(0, 1), "kth": pa.array([out.tobytes()], pa.binary())})

    shared = kth.groupBy("dim", "block").applyInArrow(known, "dim int, block int, kth binary")
    # All shards for each block, a few to a group. Pairs are listed by number;
    # the bytes of both sides join them.
    pairs = queries.select("dim", "block", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    grid = (pairs.join(trees, ["dim", "shard"]).join(queries, ["dim", "block"])
            .join(shared, ["dim", "block"], "left").select(*order, F.expr(f"shard div {GROUP}").alias("part")))
    hits = grid.groupBy("dim", "block", "part").applyInArrow(lambda t: _search(t, k), found)
    rank = F.row_number().over(Window.partitionBy("query_id", "dim", "block", "row").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
