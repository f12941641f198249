"""Registry of named queries: Spark builder + DuckDB oracle text.

Each query module registers ``name -> (fn(spark, sf_dir) -> DataFrame, sql | None)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # Import for side effects: each module registers its queries.
    for mod in ("q_graph", "q_relational", "q_text", "q_io", "q_extract", "q_stats", "q_features",
                "q_models", "q_stream", "q_roundtrip"):
        __import__(f"threadlens.plans.{mod}")


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
