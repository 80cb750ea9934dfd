"""The queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrove.plans import documents, filters, ranking, tables, vectors

_PARTS = (documents, ranking, filters, tables, vectors)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
