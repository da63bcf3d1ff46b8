"""First write per key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Most keys that are broadcast. A request id has at most 128 characters, so this many take at most about 100 MB.
MAX_BROADCAST_KEYS = 200_000


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row with the lowest ``order`` of each key.

    The rank filter is also applied before the shuffle (WindowGroupLimit): a key with very many copies leaves each task
    as a single row.
    """
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def not_stored(rows: DataFrame, stored: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` (``n_rows`` of them, unique by ``key``) whose key the much larger ``stored`` does not hold.

    With few rows the stored keys are first cut down to those that occur in ``rows``: a scan of one column of ``stored``
    against broadcast keys, and nothing large is shuffled. Many rows meet the stored keys in one join, so that ``rows`` are
    made once.
    """
    if n_rows > MAX_BROADCAST_KEYS:
        return rows.join(stored.select(key), key, "left_anti")
    hits = stored.select(key).join(F.broadcast(rows.select(key)), key, "left_semi")
    return rows.join(F.broadcast(hits), key, "left_anti")


#: Parts the copies of one key are spread over before they meet.
SPREAD = 8


def unique_stream(stream: DataFrame, key: str, order: str, spread: int = SPREAD) -> DataFrame:
    """One row per ``key`` of a stream, whichever arrives first.

    A key that is delivered over and over would send all its copies to one task. They are first thinned out in
    ``spread`` parts by ``order``, which differs between copies; 1 leaves that step out and halves the state.
    """
    if spread > 1:
        parted = stream.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(spread)))
        stream = parted.dropDuplicates([key, "_part"]).drop("_part")
    return stream.dropDuplicates([key])
