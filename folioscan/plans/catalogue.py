"""All queries of the core, by name, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscan.plans import maintenance, pages, searches, traffic

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (searches, pages, maintenance, traffic)


def queries() -> dict[str, Query]:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}
