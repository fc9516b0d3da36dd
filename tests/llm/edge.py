"""Shared fixtures of the llm tests: edge rows and a reader of small tables."""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def edge_rows():
    """Nulls, empty and blank texts, a very long text, ties, repeated rows."""
    long = " ".join(f"w{i % 977} v{i % 31}" for i in range(30_000))
    rep = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 12
    mixed = "Grüße, 世界! it's 12,5 % <|endoftext|> don't STOP\n\n  x\t\ty \U0001F600\U0001F9D1‍\U0001F680 ́a"
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, long, "en", "b", len(long)),
            (5, rep, "en", "b", len(rep)), (6, rep, "en", "b", len(rep)), (7, rep + "tail", "en", None, 1), (7, rep + "tail", "en", None, 1),
            (None, "a null id with a few words", "en", "c", 5), (None, None, None, None, None), (8, mixed, "xx", "", 3),
            (9, "one", "en", "d", 3), (9, "one", "en", "d", 3), (10, mixed + long[:4000], "en", "a", 9), (11, "\x1c\x85  　z", "en", "a", 5)]
    return rows


def edge(spark, clash=()):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    for c in clash:
        df = df.withColumn(c, F.lit("clash"))
    return df


def both(spark):
    """The small table and the edge rows, with ids that do not meet."""
    shift = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") + 1_000_000)
    return small(spark).unionByName(edge(spark).withColumn("doc_id", shift))


def collect(df):
    return [r.asDict() for r in df.collect()]
