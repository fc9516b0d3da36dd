"""Stored views (``operators.views``): one folder of partial rows per batch, and
bases that hold all batches up to a number.

``delta/batch=n``  the partial rows of batch n. Adding a batch again writes the
                   same folder anew, so a replay changes nothing.
``base/upto=n``    batches 0..n merged (``compact``). Readers take the newest
                   base and the batches after it.

A folder counts once its write has committed (``_SUCCESS``): a job that fails
before leaves the view as it was. Nothing is deleted here; folders that a base
has made idle may be removed when no reader is left. One writer per view is the
contract; batches have ascending numbers and no gap is needed. After ``compact`` a
batch at or below the base's number must not change any more (adding it again is
ignored by readers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.views import View


def _committed(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the committed folders ``path/name=n``, ascending."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{name}=*/_SUCCESS")) or []
    return sorted(int(m.getPath().getParent().getName().split("=")[1]) for m in marks)


def _parts(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest base, and the batches after it."""
    bases = _committed(spark, f"{path}/base", "upto")
    base = bases[-1] if bases else None
    return base, [n for n in _committed(spark, f"{path}/delta", "batch") if base is None or n > base]


def add_batch(view: View, rows: DataFrame, path: str, batch: int) -> None:
    """Store the partial rows of a batch: one per key of the batch. Only the batch
    is read."""
    view.partials(rows).write.mode("overwrite").parquet(f"{path}/delta/batch={batch}")


def read(view: View, spark: SparkSession, path: str) -> DataFrame | None:
    """The view over all batches, a row per key; None if there is no batch."""
    base, batches = _parts(spark, path)
    folders = [f"{path}/base/upto={base}"] * (base is not None) + [f"{path}/delta/batch={n}" for n in batches]
    if not folders:
        return None
    # Each folder is its own root, so that the numbers do not become columns.
    found = spark.read.parquet(*folders).select(*view.keys, *view.measures)
    return view.merge(found) if batches else found


def compact(view: View, spark: SparkSession, path: str) -> int:
    """Merge the newest base with the batches after it into a new base; the number
    of batches merged."""
    _, batches = _parts(spark, path)
    if batches:
        read(view, spark, path).write.mode("overwrite").parquet(f"{path}/base/upto={batches[-1]}")
    return len(batches)
