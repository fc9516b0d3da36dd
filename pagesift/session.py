"""Session helpers: a tuned builder for local runs and the shared checkpoint
folder lookup used by jobs that cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. No join side is broadcast from plan-time
# estimates; AQE re-plans joins at runtime from measured shuffle sizes, so a
# side is broadcast only once its real size is known to be below the
# threshold. AQE also coalesces small partitions and splits skewed join
# partitions.
DEFAULT_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "pagesift",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Only a local master may go without: one machine can share a folder under
    the system temp folder. On a cluster every executor has its own disk, so
    an unset folder is an error there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pagesift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    return os.path.join(checkpoint_dir(spark), name)


def limit_batches(spark: SparkSession, rows: int) -> None:
    """Send at most ``rows`` rows at once to a Python worker: the session's default
    of ten thousand is meant for short ones, and a worker keeps the memory of its
    largest batch. (The setting stays: it is read when the query runs.)"""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def stage(df, name: str = "stage"):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage, lets several consumers share one computation of
    an expensive intermediate, and survives executor loss (unlike a cache).
    Downstream scans still get column pruning and filter pushdown. The folder
    is temporary: ``spark.checkpoint.dir`` is cleared by whoever set it."""
    import uuid
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
