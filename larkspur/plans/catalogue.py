"""Every registered query of the engine's own operators, with its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans import corpus, evaluation, history, moments, records, scalar_queries, summaries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (history, corpus, evaluation, scalar_queries, summaries, moments, records)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval-censored lifecycles of all jobs."""
    return history.lifecycle_intervals(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
