"""A corpus pipeline of five operators: quality rules, exact dedup, near dedup, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact, packing, quality, secrets, similar
from tessella.llm.common import Cut, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; rules are learned from the labels of these documents."""
    rules = quality.learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, rules)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact.keep_distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with 0.8 of their five-word runs in common the document with the smallest doc_id stays."""
    return similar.keep_one_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, in encoded layers too; every document stays."""
    return secrets.without_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result written and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = Cut(spark, f"pipeline-{name}")(stage(spark, docs, sf_dir))
    return docs


#: Learned rules and similar texts have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
