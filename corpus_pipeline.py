"""The corpus pipeline: classify, near-dedup, substring dedup, mix, tokenize.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of `documents`. Its result has no SQL form: tests/llm/test_pipeline.py holds it against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvframe.llm import byte_bpe, mixing, quality_classifier, simhash, substring_dedup
from kvframe.llm.shared import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word Jaccard similarity 0.8 or more stays, that of the smallest doc_id."""
    return simhash.keep_one(docs).select(COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has too go; n_chars follows the text."""
    kept = substring_dedup.remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources to equal weight; a document comes as often as its number of copies, in the order of the shuffle."""
    return mixing.mix_sources(docs).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them, one row for each row of the mixture."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", classify), ("SimHash near-dedup", near_dedup), ("substring dedup", remove_repeats), ("mixing", mix), ("byte-level BPE", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. Each one's result but the last is written to the shared folder and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
