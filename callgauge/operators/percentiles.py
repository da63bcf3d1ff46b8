"""Exact interpolated percentiles of counted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def percentiles(counted: DataFrame, keys: list[str], value: str, weight: str, wanted: dict[str, float], **totals: Column) -> DataFrame:
    """Per ``keys`` the continuous percentiles of ``value``, each row standing for ``weight`` equal values, and totals.

    One aggregate with map-side combination. It holds a count per distinct value of a group, so ``value`` should be
    counted beforehand and have a bounded number of them. Null values count in the totals only.
    """
    found = counted.groupBy(*keys).agg(
        *[column.alias(name) for name, column in totals.items()],
        F.percentile(value, F.array(*[F.lit(p) for p in wanted.values()]), F.coalesce(weight, F.lit(0))).alias("_found"),
    )
    return found.select(*keys, *totals, *[F.get("_found", F.lit(i)).alias(name) for i, name in enumerate(wanted)])
