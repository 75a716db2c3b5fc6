"""Named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is DuckDB SQL over the same tables."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        conversion_queries,
        freshness_queries,
        index_queries,
        ingest_queries,
        link_queries,
        notes_queries,
        text_queries,
        change_queries,
    )
