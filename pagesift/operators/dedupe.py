"""First-seen dedupe, history anti-join, insert-if-absent and keyed replace.

All "keep the first/last row per key" operators are aggregations of a struct
whose leading fields are the order key (``min``/``max`` of a struct compares
field by field). Unlike a window over the key, an aggregation is combined on
the map side first, so a hot key (e.g. every keyless record sharing one
fingerprint) is reduced to one row per map task before the shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keep_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], agg) -> DataFrame:
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest]).alias("_r")
    out = df.groupBy(*keys).agg(agg(packed).alias("_r"))
    return out.select(*keys, *[F.col("_r")[c].alias(c) for c in order + rest])


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the row with the smallest ``order`` tuple.

    ``order`` must make rows unique within a key (e.g. site, page, chunk, pos)
    so the result does not depend on input order or partitioning.
    """
    return _keep_by(df, keys, order, F.min)


def last_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the row with the largest ``order`` tuple."""
    return _keep_by(df, keys, order, F.max)


def anti_history(df: DataFrame, history: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows whose key is not in the history (column-pruned key scan; never
    collected). Spark plans a hashed or sort-merge left-anti join; AQE turns
    it into a broadcast only when the measured history side is small."""
    return df.join(history.select(key), key, "left_anti")


def insert_if_absent(batch: DataFrame, history: DataFrame, key: str = "fingerprint",
                     order: Sequence[str] = ()) -> DataFrame:
    """Rows an insert-if-absent on ``key`` would really insert: the first
    version of each key in the batch (by ``order``), minus keys already in
    the history. First write wins for ever; applying the result and running
    again inserts nothing."""
    if order:
        batch = first_seen(batch, [key], order)
    else:
        batch = batch.dropDuplicates([key])
    return anti_history(batch, history, key)


def inserted_count(batch: DataFrame, history: DataFrame, key: str = "fingerprint",
                   order: Sequence[str] = ()) -> DataFrame:
    return insert_if_absent(batch, history, key, order).agg(
        F.count(F.lit(1)).cast("long").alias("inserted"))


def keyed_replace(current: DataFrame, updates: DataFrame, key: Sequence[str] | str,
                  order: Sequence[str]) -> DataFrame:
    """Upsert with replace-on-conflict: union the current table and the
    updates, keep the last row per key by ``order`` (e.g. updated_at, seq)."""
    keys = [key] if isinstance(key, str) else list(key)
    return last_seen(current.unionByName(updates), keys, order)
