"""Registered queries and the SQL statements that check them, one module per area."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from callgauge.session import prepare

AREAS = tuple(
    f"callgauge.plans.{area}"
    for area in ("metrics", "redaction", "transcript", "calls", "chunks", "validation", "ingest", "live")
)

Query = Callable[[SparkSession, str], DataFrame]


def queries(areas: tuple[str, ...] = AREAS) -> dict[str, Query]:
    """Queries of the modules named, each of which has QUERIES and ORACLE."""
    found: dict[str, Query] = {}
    for area in areas:
        found.update(import_module(area).QUERIES)
    return {name: _prepared(query) for name, query in found.items()}


def oracle_sql(areas: tuple[str, ...] = AREAS) -> dict[str, str]:
    found: dict[str, str] = {}
    for area in areas:
        found.update(import_module(area).ORACLE)
    return found


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(prepare(spark), folder)

    return run
