"""The registered queries of the library and their DuckDB twins."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .registry import ORACLES, QUERIES

for _name in ("log_queries", "sync_queries", "conversation_queries", "table_queries", "text_queries", "vector_queries", "rank_queries", "question_queries", "access_queries", "stream_queries"):
    import_module(f"{__package__}.{_name}")


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five readable chunks for each benchmark question."""
    return QUERIES["slice_answer_context"](spark, sf_dir)
