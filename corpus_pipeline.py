"""The training-data pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns documents with all their columns. Stages learn from the tables of sf_dir and the documents
they are given, never from a sample of what their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketpulse.llm import langid, minhash, mixing, packing, rules
from marketpulse.llm.common import fold, table
from marketpulse.session import configure, materialize

#: Part of the tokens that mixing keeps, whatever the rarest source, language or topic holds.
MIX_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rule ensemble learned from the labels: documents that score below 0.3 go."""
    return rules.keep_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language mixture: documents without a language that makes up half of them go."""
    return langid.keep_languages(docs, fold("doc_id", 3) != 1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Circulant MinHash over five-word shingles at similarity 0.8: one document of each group stays."""
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, sampled so that sources, languages and topics meet their target weights as far as they have tokens."""
    return mixing.sample(docs, share=MIX_SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and place of each document."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Trees, expectation-maximisation and dynamic programming are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
