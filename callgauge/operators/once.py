"""Columns that are computed a single time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns as the output of a generator.

    A filter on an ordinary computed column is moved below the projection and computes the column there once more, for
    every time it names it. It cannot be moved below a generator.
    """
    made = F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))
    return df.select(*[F.col(c) for c in df.columns if c not in columns], made)
