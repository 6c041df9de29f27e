"""A corpus pipeline of five stages; each works on all that the stage before it kept.

Language ID drops texts whose language cannot be told, SimHash keeps one document of each group of
near-duplicates, personal data is masked, the documents are mixed to target weights, and what is
left is packed into sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtlens.llm import language, mixing, packing, pii, simhash
from courtlens.llm.common import stage, unstage
from courtlens.llm.queries import quality_labels, vocabulary


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told; null texts, texts without a letter and those between languages go."""
    return language.accepted(docs, language.train(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id."""
    return simhash.keep_one(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, replaced by its kind."""
    return pii.mask(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture's rates say."""
    return mixing.sampled(docs, quality_labels(spark, sf_dir))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("language", identified), ("near_duplicates", without_near_duplicates), ("personal_data", masked),
          ("mixing", mixed), ("packing", packed)]

#: Classifiers, fingerprints and tokenising are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        if before is not None:
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
