"""The registered queries and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import documents, evaluation, exports, geometry, layout, lifecycle, operations, rules, sheets, store, text
from foliant.registry import ORACLES, QUERIES, Query

MODULES = (text, documents, store, operations, evaluation, geometry, rules, exports, sheets, lifecycle, layout)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to blocks, tokens, greedy chunks and statistics by engine."""
    return QUERIES["ag05_chunks_by_engine"](spark, sf_dir)
