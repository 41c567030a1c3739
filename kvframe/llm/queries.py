"""One query for each operator; each reads whole tables, applies its operator and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, gif, language_id, mixing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir), digest=True)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir), digest=True)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "source", "text", "copies", "copy", "shuffle_key")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("covered_words", "longest_repeat")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(documents(spark, sf_dir))


def op4_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_and_read(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_substring_dedup, op3_quality_classifier, op4_gif, op5_language_id, op6_suffix_array_dedup, op7_simhash_near_dedup, op8_byte_bpe, op9_mixing, op10_quality_rules)}
ORACLE_SQL = {"op10_quality_rules": quality_rules.ORACLE, "op2_substring_dedup": substring_dedup.ORACLE, "op6_suffix_array_dedup": suffix_dedup.ORACLE, "op9_mixing": mixing.ORACLE}
