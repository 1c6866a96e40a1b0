"""A corpus made ready for training: quality, near-duplicates, secrets, mixture, packing; each stage written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskflow.llm import compression, mixing, packing, secrets, simhash
from maskflow.llm.common import table
from maskflow.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    kept = compression.classify(docs, table(spark, sf_dir, "labels"))
    return kept.where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, the one with the smallest id."""
    return simhash.deduplicate(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced and its length counted anew."""
    return secrets.redact(docs).withColumns({"n_chars": secrets.length_of("text", docs.schema["n_chars"].dataType)})


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and those of small sources up to twice."""
    return mixing.mix(docs).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("secret scan", hide_secrets),
    ("source mixing", mixture),
    ("mixture packing", sequences),
]

# A classifier by compression and a tokenizer have no SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
