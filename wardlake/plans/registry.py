"""Named queries: one Spark builder and (where SQL can express it) one
DuckDB oracle statement per key.

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole test tables.  Oracle SQL is written against the base tables plus the
adapter views of ``wardlake.sources.fixtures`` (prepended as CTEs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlake.sources.fixtures import with_views

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, Callable[[], str] | str] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def oracle_sql(name: str) -> str:
    """Oracle text with the adapter views (and any query-specific CTEs,
    when the registered SQL is a ``(sql, {name: cte_sql})`` pair) prepended."""
    sql = ORACLE[name]
    sql = sql() if callable(sql) else sql
    if isinstance(sql, tuple):
        return with_views(sql[0], sql[1])
    return with_views(sql)


def load_all() -> None:
    """Import every module that registers queries."""
    from wardlake.plans import (  # noqa: F401
        dashboard_queries, rule_queries, matching_queries, scheduling_queries,
        retrieval_queries, consensus_queries, chat_queries, lake_queries, ml_queries, case_queries,
    )
