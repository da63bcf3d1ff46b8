"""Ordered look-around that does not put a whole group into one task.

A window ``PARTITION BY conversation`` hands every message of a conversation to one task, however long it is. The order
column is an integer that is unique within its group, so a block of ``BLOCK`` numbers has no more rows than that. Windows
run per (key, block), and in groups of several blocks the rows from across the border that a window needs are copied in
beforehand, so that results are those of the uncut window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F

#: Width of a block in units of the order column, hence the most rows of one key a window task holds.
BLOCK = 4096

#: Adds window columns to a table, given the columns to partition by.
Compute = Callable[[DataFrame, list[str]], DataFrame]


def over_neighbours(
    df: DataFrame, key: str, order: str, k: int, compute: Compute, *, ahead: bool = False, block: int = BLOCK
) -> DataFrame:
    """``compute`` over the groups of ``key``, for windows that reach at most ``k`` rows back (or ``ahead``).

    Every group is cut into blocks. A group within one block, as nearly all are, has no border, and nothing is copied.
    """
    near = with_neighbours(df, key, order, k, ahead=ahead, block=block)
    return compute(near, [key, "_block"]).where(~F.col("_halo")).drop("_block", "_halo")


def with_neighbours(df: DataFrame, key: str, order: str, k: int, *, ahead: bool, block: int) -> DataFrame:
    """``df`` plus, for every (key, ``_block``), the ``k`` rows next to it, marked by ``_halo``.

    Only k rows per block travel across: each block keeps its k rows nearest to the border, and as every listed block
    holds a row, the k nearest blocks always hold the k nearest rows.
    """
    placed = df.withColumn("_block", F.floor(F.col(order) / block))
    toward = F.col(order).asc() if ahead else F.col(order).desc()
    rank = F.row_number().over(W.partitionBy(key, "_block").orderBy(toward))
    rest = [c for c in df.columns if c not in (key, order)]
    # groups of several blocks; usually there are none, and the plan below them falls away while it runs
    long = placed.groupBy(key).agg((F.max("_block") > F.min("_block")).alias("_long")).where("_long").select(key)
    borders = (
        placed.join(long, key, "left_semi")
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= k)
        .groupBy(key, "_block")
        .agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("_edge"))
    )
    by_block = W.partitionBy(key).orderBy("_block")
    span = by_block.rowsBetween(1, k) if ahead else by_block.rowsBetween(-k, -1)
    near = F.flatten(F.collect_list("_edge").over(span))
    nearest = F.slice(near if ahead else F.reverse(near), 1, k)
    halo = (
        borders.select(key, "_block", nearest.alias("_near"))
        .select(key, "_block", F.explode("_near").alias("_row"))
        .select(key, "_block", "_row.*", F.lit(True).alias("_halo"))
    )
    return placed.withColumn("_halo", F.lit(False)).unionByName(halo)


def next_value(df: DataFrame, key: str, order: str, value: str, alias: str, block: int = BLOCK) -> DataFrame:
    """``lead(value) OVER (PARTITION BY key ORDER BY order)``."""

    def lead(rows: DataFrame, groups: list[str]) -> DataFrame:
        return rows.withColumn(alias, F.lead(value).over(W.partitionBy(*groups).orderBy(order)))

    return over_neighbours(df, key, order, 1, lead, ahead=True, block=block)
