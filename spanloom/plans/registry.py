"""Queries over the driver's tables and the DuckDB SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a (spark, sf_dir) function to QUERIES, and its SQL to ORACLES."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from spanloom.plans import corpus, evaluation, exchange, quality, timeline  # noqa: E402, F401  (they register themselves)
