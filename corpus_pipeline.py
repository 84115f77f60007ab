"""Curation of ``documents``: each stage calls one operator of ``zephra.llm`` on all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared checkpoint folder
and reads it again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zephra.llm import decontamination, mixing, pii, quality, simhash
from zephra.scale import cut_lineage


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is at least one half."""
    return quality.select_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 4 differing bits of the fingerprint over 4-word shingles."""
    return simhash.one_of_each(docs, width=4, tau=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs, pii.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked probabilities; adds topic, n_tokens, probability and weight."""
    return mixing.sample(mixing.with_topic(docs, spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


STAGES = [
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii_redaction", redact),
    ("source_mixing", mix),
]

#: SQL has neither the hash of the fingerprints nor the fitted models; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
