"""From documents to token ids: five stages, each on what the one before kept.

1. quality: documents that the ordinal classifier rejects go.
2. near_duplicates: one document of each group of near duplicates stays.
3. secrets: secrets in the texts are masked (``n_chars`` follows the text).
4. mix: documents are drawn so that the sources meet their target weights;
   a document may come up to three times.
5. encode: texts become BPE ids, with a digest of their decoding.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. Between stages the rows are written as Parquet
to the shared folder and read again.

Nulls, empty and very long texts, repeated rows, empty tables and extra
columns are handled as each operator's docstring says: null and empty texts
are judged by the thresholds alone, a null text is never a duplicate, texts
without a word are not drawn into the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesift.llm import apportion, bpe, order_minhash, ordinal, queries, secrets
from pagesift.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = ordinal.train(docs, queries.ratings(spark, sf_dir))
    return ordinal.select_good(docs, model, tail_grade=queries.GOOD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs, *queries.secret_forest(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apportion.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, queries.tokenizer_path(), with_ids=True, passed=("lang", "source"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", mask_secrets), ("mix", mix), ("encode", encode)]

# Fitted models and the BPE have no SQL form; the tests hold each stage against
# a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
