"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import diff_queries, metric_queries, other_queries

FLAGSHIP = "headline_scores"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**metric_queries.QUERIES, **diff_queries.QUERIES, **other_queries.QUERIES}
ORACLES: dict[str, str] = {**metric_queries.ORACLES, **diff_queries.ORACLES, **other_queries.ORACLES}
