"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and works on
all that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelog.llm import decontaminate, jaccard_join, mixing, pii, quality
from wirelog.llm.frames import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id.

    Rows without id can't be told apart and stay; rows that repeat an id stay with it.
    """
    classes = jaccard_join.near_duplicates(docs)
    others = classes.where("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    redacted = pii.redact_pii(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        redacted = redacted.withColumn("n_chars", F.length("text").cast(kind))
    return redacted


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, with repeats."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixing),
]

#: Hashed n-grams, MinHash and seeds are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = scratch.store(docs, f"stage-{number}")
    return docs
