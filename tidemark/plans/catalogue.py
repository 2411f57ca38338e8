"""The registered queries, and for each that SQL can express the DuckDB query with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import q_blocks, q_dedup, q_match, q_metrics, q_signal, q_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (q_dedup, q_match, q_metrics, q_signal, q_tables, q_blocks):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
