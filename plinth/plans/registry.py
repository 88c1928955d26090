"""Names of the engine's own queries, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from plinth.plans import cleaned_queries, cleaning_queries, index_queries, reading_queries, record_queries, screen_queries, serving_queries, state_queries, stream_queries, surface_queries
from plinth.session import compiled

GROUPS = (index_queries, screen_queries, cleaning_queries, cleaned_queries, serving_queries, reading_queries, record_queries, stream_queries, state_queries, surface_queries)


def _compiled(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(compiled(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _compiled(query) for group in GROUPS for name, (query, _) in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
