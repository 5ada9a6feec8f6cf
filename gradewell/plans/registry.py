"""Registry of named queries: each is a Spark callable ``(spark, sf_dir) ->
DataFrame`` and, where SQL can express the answer, the DuckDB oracle text
over the driver's views (same column names, same rounding)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so its decorators run."""
    from gradewell.plans import (q_profile, q_integrity, q_metrics, q_checks,  # noqa: F401
                                 q_episodes, q_verdicts, q_models, q_sources, q_streaming)
