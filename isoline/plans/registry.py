"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isoline.plans import geometry_queries, graph_queries, line_queries, listing_queries, polyline_queries, register_queries, source_queries, text_pipe_queries, text_queries, tracing_queries, vector_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _m in (line_queries, text_queries, geometry_queries, graph_queries, text_pipe_queries, tracing_queries, listing_queries, polyline_queries, vector_queries, register_queries, source_queries):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems and circuits of the derived line tags."""
    return QUERIES["circuits"](spark, sf_dir)
