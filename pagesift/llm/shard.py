"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows are put in a seeded random order within their source and get the rank
``r`` there; the fractional rank ``(r + u) / n`` (``n`` rows of the source,
``u`` a seeded offset of the source in [0, 1)) spreads each source evenly over
[0, 1). All rows in the order of their fractional rank are cut into equal
runs: every run holds each source in its proportion, to about one row.

Both rankings are exact and distributed. A seeded hash deals the rows of a
source over cells (ranges of the hash), and the fractional rank deals all rows over cells; rows are
numbered within a cell, and a running sum of the cell counts gives the start
of each cell. The number of cells follows the shuffle partitions, so neither
a hot source nor the whole table meets in one task, and only narrow rows
(never texts) are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS_PER_PARTITION = 4


def _unit(c: Column) -> Column:
    """60 seeded bits of a string as a long."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def _cell(rnd: Column, cells: int) -> Column:
    """The cell of a rank key of 60 bits, its leading bits: at least ``cells``
    ranges of it, so that the order of rows does not depend on their number."""
    bits = max(0, cells - 1).bit_length()
    return F.shiftright(rnd, 60 - bits)


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long")


def shard(df: DataFrame, n_shards: int, *, id_col: str = "doc_id", source_col: str = "source",
          text_col: str = "text", seed: int = 0) -> DataFrame:
    """Assign every row of ``df`` to one of ``n_shards`` shards.

    Returns (id, source, size, text_crc32, shard, slot): one row per input row.
    Shard sizes differ by at most one row, ``slot`` counts from 0 without gaps
    in each shard, and reruns agree whatever the partitioning and settings.

    Defined cases: a null source is a source of its own; a null id orders like
    an empty string; a null text has size 16 and the checksum of no bytes;
    repeated rows are all placed (equal rows are interchangeable); an empty
    table gives no rows; fewer rows than shards leave some shards empty; other
    columns are ignored, so their names cannot clash.
    """
    spark = df.sparkSession
    cells = CELLS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    order = _unit(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    rows = df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("skey"), order.alias("rnd"),
        text_size(F.col(text_col)).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"),
    ).withColumn("cell", _cell(F.col("rnd"), cells))

    # Order within the source: (cell, rnd, id, ...); cells are counted first.
    counts = (df.select(key.alias("skey"), _cell(order, cells).alias("cell"))
              .groupBy("skey", "cell").agg(F.count(F.lit(1)).alias("n")))
    by_source = Window.partitionBy("skey")
    running = by_source.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "skey", "cell", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"),
        F.sum("n").over(by_source).alias("total"))
    in_cell = Window.partitionBy("skey", "cell").orderBy("rnd", "id", "size", "crc")
    offset = _unit(F.concat_ws(":", F.lit(f"source{seed}"), F.col("skey"))) / F.lit(float(1 << 60))
    ranked = (rows.withColumn("k", F.row_number().over(in_cell) - 1)
              .join(starts, ["skey", "cell"])
              .withColumn("f", (F.col("before") + F.col("k") + offset) / F.col("total"))
              .withColumn("cell", F.least(F.floor(F.col("f") * cells), F.lit(cells - 1)).cast("long"))
              .select("id", "source", "skey", "rnd", "size", "crc", "f", "cell"))

    # The same by fractional rank over all sources: the per-cell totals are a
    # table of `cells` rows.
    totals = ranked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    all_before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("cell", F.coalesce(F.sum("n").over(all_before), F.lit(0)).alias("before"),
                           F.sum("n").over(whole).alias("total"))
    within = Window.partitionBy("cell").orderBy("f", "skey", "rnd", "id", "size", "crc")
    placed = (ranked.withColumn("k", F.row_number().over(within) - 1)
              .join(totals, "cell")
              .withColumn("pos", F.col("before") + F.col("k")))
    shard_no = F.expr(f"pos * {n_shards} div total")
    return (placed.withColumn("shard", shard_no.cast("int"))
            .withColumn("slot", F.col("pos") - F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}"))
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size",
                    F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot")))
