"""Connected components of an edge table, by alternating star contraction.

Each round links the larger neighbours of a node, then its smaller ones, to the
smallest node around it; the edges end as stars around the smallest node of
each component. Only edges are shuffled; a round is written to the shared
folder, and the write itself reports the checksum that ends the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pagesift.session import stage


def _link(edges: DataFrame) -> DataFrame:
    """Each (u, v) and the smallest of u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node
    of its component. Loops and repeated edges are harmless; nodes are never
    null. No edges give no rows."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _link(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _link(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        seen = Observation()
        e = stage(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        now = seen.get
        if not now["n"] or now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def extend(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after more edges (a, b): only the roots that the new edges
    join are brought together. Written to the shared folder."""
    root = F.coalesce("root", "node")
    joined = edges.select(F.col("a").alias("node"), "b").join(roots, "node", "left").select(root.alias("a"), F.col("b").alias("node"))
    joined = joined.join(roots, "node", "left").select("a", root.alias("b"))
    more = components(joined.filter("a <> b")).select(F.col("node").alias("old"), F.col("root").alias("top"))
    moved = roots.join(more, F.col("root") == F.col("old"), "left").select("node", F.coalesce("top", "root").alias("root"))
    new = more.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("top").alias("root"))
    return stage(moved.unionByName(new), "roots")
