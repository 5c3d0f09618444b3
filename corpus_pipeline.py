"""Corpus preparation: five stages over ``documents``, each a training-data operator.

toxicity (documents it rejects go), SimHash near-dedup (one document of each
component stays), benchmark decontamination (contaminated documents go), secret
scan (secrets are masked), mixing to target weights (documents are repeated or
left out).  Every stage but the last returns the columns of ``documents``; the
last adds ``copy``, the number of the repetition, from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from companion.llm import decontaminate, mixing, secrets_scan, simhash, toxicity
from companion.session import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_scan.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("mixing", mixing_stage),
]

# Stages 1, 2 and 4 rest on a trained model, XXH64 and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each over the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, "pipeline-stage")
    return docs
