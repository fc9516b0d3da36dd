"""The llm operators bound to the test tables (SQL in ``oracle``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import (apportion, balltree, bpe, compression, order_minhash, ordinal, packing, piece_table, rabinkarp, secrets,
                          shard, stripes, suffix_tree)
from pagesift.llm.oracle import ORACLE_SQL

N_SHARDS = 40
GOOD = 2  # the best grade


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.shard(documents(spark, sf_dir), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op2_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), suffix_tree.held_out(F.col("doc_id"))
    tree, counts = suffix_tree.train(docs, train_on=~held)
    return suffix_tree.score(docs, tree, counts, held=held)


def op3_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), tokenizer_path())


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.rules(documents(spark, sf_dir))


def secret_forest(docs: DataFrame) -> tuple[list[str], list[str]]:
    """The dictionary, and the forest from written findings and those of ``docs``
    that their context labels."""
    words = secrets.dictionary(docs)
    return words, secrets.train(secrets.labelled_by_context(docs, words), secrets.written_findings(docs.sparkSession, words))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan(docs, *secret_forest(docs))
    return found.select("doc_id", "n_candidates", "n_secrets", "findings", F.sha2("redacted", 256).alias("redacted_sha256"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(documents(spark, sf_dir)).drop("fp")


def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = apportion.mix(documents(spark, sf_dir))
    shards = F.array_join(F.transform("shards", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["words"].cast("string"))), " ")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "blocks", shards.alias("shards"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return ordinal.score(docs, ordinal.train(docs, ratings(spark, sf_dir)), tail_grade=GOOD)


def op9_ball_tree_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return balltree.top_k(vectors, 5, is_query=F.col("vec_id") % 50 == 0)


def op10_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabinkarp.dedup(documents(spark, sf_dir))


def op11_piece_table_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = piece_table.transform(documents(spark, sf_dir), with_output=True)
    return piece_table.restore(moved).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op13_stripe_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stripes.mine(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_stratified_shards, op2_suffix_tree_scores, op3_forced_boundary_bpe, op4_compression_bands,
                            op5_secret_forest, op6_order_minhash, op7_sainte_lague_mix, op8_ordinal_quality, op9_ball_tree_top5,
                            op10_window_dedup, op11_piece_table_fim, op12_best_fit_packing, op13_stripe_collocations)
}

__all__ = ["ORACLE_SQL", "QUERIES"]
