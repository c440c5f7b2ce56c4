"""A corpus preparation pipeline: stages that each take the documents their predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isoline.llm import stages
from isoline.session import cut, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.toxicity),
    ("exact_dedup", stages.exact_dedup),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("benchmark_decontamination", stages.decontamination),
    ("bpe_round_trip", stages.bpe_round_trip),
]

#: Model scores and edit-tolerant fingerprints have no SQL form; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder and read back.

    What a stage wrote is deleted as soon as the next one has written its own.
    """
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}", written)
    return STAGES[-1][1](spark, docs, sf_dir)
