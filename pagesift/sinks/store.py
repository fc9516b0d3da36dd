"""Table writes on Parquet directories (no in-place update, no MERGE).

* ``insert_if_absent`` — first write wins on a key: anti-join the batch
  against the table's key column, append the rest. Replaying the same batch
  appends nothing, so at-least-once callers (streaming ``foreachBatch``,
  retried jobs) stay exact. One writer per table is the contract.
* ``append_events`` — append-only event rows (queue jobs, runs).
* ``upsert_buckets`` — last write wins, stored: only the buckets that change are
  written anew.
* ``merge_by_key`` — last write wins: current ∪ updates, last row per key, as
  a DataFrame for the caller to write.

Row counts come from ``Observation`` metrics collected during the write, so
no second pass over the data is needed.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe
from ..session import stage


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a table directory exists (any Hadoop file system)."""
    try:
        jvm = spark.sparkContext._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.exists(hpath))
    except Exception:  # no JVM handle: probe by reading the schema
        try:
            spark.read.parquet(path).schema
            return True
        except Exception:
            return False


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    if _exists(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def insert_if_absent(batch: DataFrame, path: str, key: str = "fingerprint",
                     order: Sequence[str] = (), partition_by: Sequence[str] = ()) -> int:
    """Append the rows of ``batch`` whose key is not yet in the table at
    ``path`` (first version per key by ``order``). Returns the number of rows
    really inserted; an empty batch inserts 0."""
    spark = batch.sparkSession
    hist = read_or_empty(spark, path, batch.select(key).schema).select(key)
    new = dedupe.insert_if_absent(batch, hist, key, order)
    obs = Observation(f"inserted_{uuid.uuid4().hex[:8]}")
    w = new.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return int(obs.get.get("n", 0))


def append_events(events: DataFrame, path: str, once: Sequence[str] = ()) -> None:
    """Append event rows; with ``once`` those whose columns of that name are not
    in the table yet, so that a replay appends nothing."""
    if once:
        there = read_or_empty(events.sparkSession, path, events.schema).select(*once)
        events = events.join(there, list(once), "left_anti").select(*events.columns)
    events.write.mode("append").parquet(path)


def merge_by_key(current: DataFrame, updates: DataFrame, key: Sequence[str] | str,
                 order: Sequence[str]) -> DataFrame:
    """The table after a keyed upsert with replace-on-conflict (last row per key
    by ``order``); the caller writes it where and how its tables are kept."""
    return dedupe.keyed_replace(current, updates.select(*current.columns), key, order)


# ------------------------------------------------- keyed table in buckets

BUCKET = "bucket"


def upsert_buckets(updates: DataFrame, path: str, key: Sequence[str] | str, order: Sequence[str],
                   buckets: int = 256) -> int:
    """Upsert with replace-on-conflict into the table at ``path``, kept in folders
    ``bucket=n`` by the hash of the key. Returns the number of rows written over
    or added.

    The last row per key by ``order`` wins, as in ``merge_by_key``. An update that is not later than the
    stored row changes nothing, so a replay writes no file. Only buckets with a
    winning update are read whole and written anew; the others are neither
    listed in the write nor touched. New files are written beside the old ones
    and take their place when the write commits, so a job that fails before
    leaves the old version. ``buckets`` is fixed when the table is made; the
    numbers of touched buckets (at most that many) are what the driver sees.
    One writer per table is the contract. Columns of the table stay as they are.
    """
    spark = updates.sparkSession
    keys, order = [key] if isinstance(key, str) else list(key), list(order)
    number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    batch = stage(dedupe.last_seen(updates, keys, order).withColumn(BUCKET, number), "updates")
    if _exists(spark, path):
        table = spark.read.parquet(path)
        batch = batch.select(*table.columns)
        touched = [r[0] for r in batch.select(BUCKET).distinct().collect()]
        stored = table.where(F.col(BUCKET).isin(touched))
        at = F.struct(*order)
        there = stored.select(F.struct(*keys).alias("_key"), F.xxhash64(*keys).alias("_h"), at.alias("_at"))
        won = batch.join(there, (F.xxhash64(*keys) == F.col("_h")) & F.struct(*keys).eqNullSafe(F.col("_key")), "left")
        won = stage(won.where(F.col("_h").isNull() | (at > F.col("_at"))).select(*batch.columns), "winners")
        touched = [r[0] for r in won.select(BUCKET).distinct().collect()]
        if not touched:
            return 0
        merged = dedupe.last_seen(table.where(F.col(BUCKET).isin(touched)).unionByName(won), keys, order)
    else:
        won = merged = batch
    (merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET).parquet(path))
    return won.count()


# ------------------------------------------------- bucketed record table

def create_bucketed_table(df: DataFrame, name: str, key: str = "fingerprint",
                          buckets: int = 512) -> None:
    """Save ``df`` as a catalog table bucketed and sorted by ``key``.

    With the history stored this way, the insert-if-absent anti-join reads
    the history side already hash-partitioned by key (no Exchange on the
    large side); only the incoming batch is shuffled. Choose ``buckets``
    equal to the job's shuffle partition count.
    """
    (df.write.bucketBy(buckets, key).sortBy(key).format("parquet")
       .mode("errorifexists").saveAsTable(name))


def insert_if_absent_table(batch: DataFrame, name: str, key: str = "fingerprint",
                           order: Sequence[str] = ()) -> int:
    """Insert-if-absent into a bucketed catalog table (see
    ``create_bucketed_table``); appended files keep the table's bucketing."""
    spark = batch.sparkSession
    table = spark.table(name)
    new = dedupe.insert_if_absent(batch.select(*table.columns), table, key, order)
    obs = Observation(f"inserted_{uuid.uuid4().hex[:8]}")
    new.observe(obs, F.count(F.lit(1)).alias("n")).write.insertInto(name)
    return int(obs.get.get("n", 0))
