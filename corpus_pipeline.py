"""The corpus pipeline: five stages over ``documents``, each on what its predecessor kept.

Cases, for every stage: columns beyond those of ``documents`` stay beside the text and cannot
clash with what a stage computes; an empty table gives an empty one; very long texts are read
whole; repeated rows and null ids are documents of their own, unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from railguard.llm.decontaminate import contamination
from railguard.llm.packing import pack
from railguard.llm.quality import judged
from railguard.llm.secrets import redact_documents
from railguard.llm.simhash import deduplicate


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the boosted trees reject go.

    Null and empty texts have no words and go; a score equal to the threshold is kept; without
    labels of both kinds the base rules decide alone.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(spark, docs, labels, docs.columns).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays.

    The row of the smallest id stays, null ids last; repeated rows and texts without words are
    near duplicates of each other like any others.
    """
    return deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by ``benchmark`` go; the others stay as they are.

    Null texts have no words and stay; items without words, or no items, contaminate nothing;
    a document exactly at the limit goes.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = contamination(docs, benchmark, carry=docs.columns)
    return judged.filter("NOT contaminated").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays.

    A null text stays null; overlapping spans are masked as one.
    """
    return redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixture-controlled sequences of at most 1024 tokens.

    A null or empty text is the closing id alone; a null source is a queue of its own.
    """
    return pack(docs).drop("source", "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: SQL can express neither fingerprints nor boosted trees nor compression.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
