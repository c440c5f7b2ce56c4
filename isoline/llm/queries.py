"""Queries of the operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isoline.llm import bpe, contamination, counts, exact, licenses, lines, records, simhash, tokens, toxicity, urls
from isoline.session import table

#: The rules of op10_url_filter's contract. urls.RULES, which its SQL is made of, has another verdict for net/de/.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as records and read back."""
    manifest = records.write_records(table(spark, sf_dir, "documents"), tokens.default_path("word_bpe_49k.json"), end_id=1)
    return records.read_records(spark, manifest)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document."""
    return counts.count_tokens(table(spark, sf_dir, "documents"), tokens.default_path("piece_bpe_32k.model"), limit=4096)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of links and verdict of every line of every document."""
    return lines.near_lines(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document, by a model fitted on labelled documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return contamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in documents, with coverage and spans."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact.exact_groups(table(spark, sf_dir, "documents")).drop("locator")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


_ALL = (op1_token_records, op2_bpe_round_trip, op3_token_counts, op4_line_dedup, op5_toxicity, op6_benchmark_decontamination, op7_license_scan, op8_simhash_near_dedup, op9_exact_dedup, op10_url_filter)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {
    "op9_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{urls._UPPER}', '{urls._LOWER}') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)""",
    "op10_url_filter": urls.sql(),
}
