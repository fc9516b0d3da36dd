"""Change rows between two snapshots of a keyed table.

A change row is (version, key columns, op, before, after): ``op`` is insert,
update or delete, ``before`` and ``after`` are the other columns as structs (null
where the row was not there). Change rows can be applied to the old snapshot,
and a delete of parents makes the change rows of their children (cascade or
set null), so a reader who follows the changes of both tables stays consistent.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def _keys(key: Sequence[str] | str) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def snapshot_changes(old: DataFrame, new: DataFrame, key: Sequence[str] | str, version: int) -> DataFrame:
    """Change rows that lead from ``old`` to ``new``, two snapshots with the same
    columns and at most one row per key (null keys are keys too).

    Both sides are joined on a hash of the key (so that null keys meet) and the
    key itself; rows that are equal in every column, nulls included, are no
    change. One shuffle of each side; sides bucketed by ``_k`` are not moved.
    """
    keys = _keys(key)
    rest = [c for c in old.columns if c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.xxhash64(*keys).alias("_k"), F.struct(*keys).alias(f"{name}_key"), F.struct(*rest).alias(name))

    both = side(old, "before").join(side(new, "after").withColumnRenamed("_k", "_k2"),
                                    (F.col("_k") == F.col("_k2")) & F.col("before_key").eqNullSafe(F.col("after_key")), "full")
    there, here = F.col("before_key").isNotNull(), F.col("after_key").isNotNull()
    op = F.when(~there, F.lit(INSERT)).when(~here, F.lit(DELETE)).otherwise(F.lit(UPDATE))
    changed = both.where(~(there & here) | ~F.col("before").eqNullSafe(F.col("after")))
    name = F.coalesce("after_key", "before_key")
    return changed.select(F.lit(version).cast("long").alias("version"), *[name[c].alias(c) for c in keys],
                          op.alias("op"), "before", "after")


def apply_changes(old: DataFrame, changes: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """The snapshot after the changes of one version, with the columns of ``old``.
    Applying them again gives the same rows."""
    keys = _keys(key)
    touched = changes.select(F.xxhash64(*keys).alias("_k"), F.struct(*keys).alias("_key"))
    same = old.withColumn("_o", F.xxhash64(*keys)).join(
        touched, (F.col("_o") == F.col("_k")) & F.struct(*keys).eqNullSafe(F.col("_key")), "left_anti").drop("_o")
    written = changes.where(F.col("op") != DELETE).select(*[F.col(c) if c in keys else F.col("after")[c].alias(c) for c in old.columns])
    return same.unionByName(written)


def cascade(parents: DataFrame, parent_key: str, children: DataFrame, key: Sequence[str] | str, foreign: str,
            set_null: bool = False) -> DataFrame:
    """Change rows of ``children`` that follow from the deletes among the change
    rows of their parents: children of a deleted parent are deleted, or lose
    their reference. The version is that of the parent's change."""
    keys = _keys(key)
    rest = [c for c in children.columns if c not in keys]
    gone = parents.where(F.col("op") == DELETE).select(F.col("version"), F.col(parent_key).alias("_parent"))
    hit = children.join(gone, F.col(foreign) == F.col("_parent"))
    before = F.struct(*rest)
    after = F.struct(*[F.lit(None).cast(children.schema[c].dataType).alias(c) if c == foreign else F.col(c) for c in rest])
    if not set_null:
        after = F.when(F.lit(False), after)
    return hit.select("version", *keys, F.lit(UPDATE if set_null else DELETE).alias("op"), before.alias("before"), after.alias("after"))
