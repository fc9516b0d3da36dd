"""Sources: Parquet tables, site configs from JSON, raw HTML files, page text of
documents, and the pending-job queue (batch and streaming)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import SITE_SCHEMA


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``{root}/{name}.parquet`` (a file or a directory of part files)."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def sites_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Site configs from a JSON array file. Separator objects holding only
    ``note*`` keys are dropped; defaults are applied (enabled true, delay 2000)."""
    raw = spark.read.schema(SITE_SCHEMA).option("multiLine", True).json(path)
    return (raw.where(F.col("name").isNotNull())
               .withColumn("enabled", F.coalesce("enabled", F.lit(True)))
               .withColumn("delay_ms", F.coalesce("delay_ms", F.lit(2000)))
               .withColumn("id", F.coalesce("id", F.sha2(F.concat_ws("\u0000", "name", "url"), 256)
                                            .substr(1, 32))))


def html_files(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """Raw HTML files as (page_id, url, html); the path is the URL."""
    raw = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
                .option("recursiveFileLookup", "true").load(path))
    return raw.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"),
                      F.col("content").cast("string").alias("html"))


def pages_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("page_id", T.LongType()),
                           T.StructField("url", T.StringType()),
                           T.StructField("html", T.StringType())])
    return spark.readStream.schema(schema).parquet(path)
