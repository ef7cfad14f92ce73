"""The registered queries of the operators. Each runs its operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import anisotropic, jaccard, licenses, packing, prefix_bpe, quote_links, records, rules, secrets, shards


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.link_quotes(table(spark, sf_dir, "conversations"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.minimax_shards(table(spark, sf_dir, "documents"), shards=8).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "capacity",
    )


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return prefix_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quote_links": quote_links.ORACLE, "op5_jaccard_components": jaccard.ORACLE, "op9_quality_rules": rules.ORACLE}
