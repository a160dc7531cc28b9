"""From raw documents to token ids: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm import common, linededup, mixing, quality, sentencepiece_fst, simhash


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier go, and documents made of nothing else."""
    return linededup.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take their target numbers of words; a document used twice is two rows; rows stand in training order."""
    return mixing.training_order(docs, mixing.mix(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return sentencepiece_fst.encode(docs)


STAGES = [
    ("quality classifier", filter_quality),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: The classifier, the fingerprints and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
