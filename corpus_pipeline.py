"""The training-data pipeline: quality, near-duplicates, secrets, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of `documents`. `run` writes each stage's rows to the shared folder and reads them
again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketpulse.llm import bpe, importance, mixing, near_duplicates, secrets
from marketpulse.session import materialized


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the importance sample; the others go."""
    return importance.keep_sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_duplicates.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secrets.redact_documents(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn at their rates; those of scarce domains may come more than once."""
    return mixing.mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the count of its tokens, and digests of the ids and of the text decoded from them."""
    return bpe.token_digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("secret scan", secret_scan),
    ("mixing", mixing_weights),
    ("tokens", tokenized),
]

#: Sampling noise, a trained forest and fitted rates aren't expressible in SQL; tests/llm hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
