"""The stages of corpus_pipeline.py: each takes (spark, docs, sf_dir) and returns what goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoline.llm import bpe, contamination, exact, simhash, tokens
from isoline.llm import toxicity as severity
from isoline.session import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, does not find toxic."""
    return severity.drop_toxic(docs, severity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact.drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the row with the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document kept, with the digest of the text they decode to."""
    return bpe.encode_decode(docs, tokens.default_path("byte_bpe_50k.json"))
