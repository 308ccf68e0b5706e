"""Registry of the named queries bound to the driver's tables.

Each entry is a callable ``(spark, sf_dir) -> DataFrame`` plus, where the
operator is expressible in SQL, the equivalent DuckDB SQL over the same
tables.  Column names and types are aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}
_OPS: dict[str, str] = {}


def query(name: str, ops: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``ops`` lists the SURVEY ids it covers."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        _OPS[name] = ops
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn

    return deco


def _load() -> None:
    # Importing the binding modules fills the registry.
    from weft.plans import (  # noqa: F401
        agent_queries,
        file_queries,
        ops_queries,
        record_queries,
        sequence_queries,
        source_queries,
        stream_queries,
    )


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def operators() -> dict[str, str]:
    _load()
    return dict(_OPS)
