"""Logs and conversations stored by conversation, so that drilling down and joining moves nothing.

Both tables are bucketed and sorted by the conversation's id with the same number of buckets: a lookup reads one bucket, and
aggregates and joins by conversation run bucket by bucket without a shuffle.

A conversation is a key like any other and may have a third of all rows, which would make one bucket one task's work. Those
with more than ``WIDE_ROWS`` logs are kept in a second table that is not bucketed; there are at most rows / ``WIDE_ROWS`` of
them. Their logs are combined on the map side or joined with the few headers they have. Logs without a conversation are kept
there as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.operators import access, transcript

#: Most logs of a conversation that lie in one bucket.
WIDE_ROWS = 10_000_000
KEY = "conversation_id"


@dataclass(frozen=True)
class Store:
    """Names of the tables."""

    logs: str
    wide: str
    conversations: str


def write(
    logs: DataFrame, conversations: DataFrame, name: str, path: str, buckets: int, wide_rows: int = WIDE_ROWS
) -> Store:
    """Stores both tables under ``path`` (shared by all executors). ``conversations`` are known by ``conv_id``, of the
    type of the logs' ``conversation_id``."""
    store = Store(f"{name}_logs", f"{name}_wide", f"{name}_conversations")
    wide = logs.where(F.col(KEY).isNotNull()).groupBy(KEY).count().where(F.col("count") > wide_rows).select(KEY)
    # the keys are few by definition, the table of their logs is what may be large
    narrow = logs.where(F.col(KEY).isNotNull()).join(wide, KEY, "left_anti").select(*logs.columns)
    rest = logs.join(wide, KEY, "left_semi").select(*logs.columns).unionByName(logs.where(F.col(KEY).isNull()))
    headers = conversations.withColumnRenamed("conv_id", KEY)
    for rows, table, order in ((narrow, store.logs, [KEY, "requested_at"]), (headers, store.conversations, [KEY])):
        # dealt like the buckets, so each is one file
        dealt = rows.repartition(buckets, KEY)
        dealt.write.mode("overwrite").bucketBy(buckets, KEY).sortBy(*order).option("path", f"{path}/{table}").saveAsTable(table)
    rest.sortWithinPartitions(F.col(KEY).asc_nulls_first(), "requested_at").write.mode("overwrite").option(
        "path", f"{path}/{store.wide}"
    ).saveAsTable(store.wide)
    return store


def of_conversation(spark: SparkSession, store: Store, conversation_id) -> DataFrame:
    """Its logs, newest first: one bucket and the row groups of the wide table that can hold it."""
    both = spark.table(store.logs).unionByName(spark.table(store.wide))
    return access.of_conversation(both, conversation_id)


def headers(spark: SparkSession, store: Store) -> DataFrame:
    return spark.table(store.conversations).withColumnRenamed(KEY, "conv_id")


def with_conversation(spark: SparkSession, store: Store) -> DataFrame:
    """Logs with title and status of their conversation. Only the few headers of wide conversations are moved."""
    known = headers(spark, store)
    narrow = transcript.logs_with_conversation(spark.table(store.logs), known)
    return narrow.unionByName(transcript.logs_with_conversation(spark.table(store.wide), _of_wide(spark, store, known)))


def usage(spark: SparkSession, store: Store) -> DataFrame:
    """Calls, errors, tokens and latency per conversation."""
    known = headers(spark, store)
    narrow = transcript.conversation_usage(spark.table(store.logs), known)
    return narrow.unionByName(transcript.conversation_usage(spark.table(store.wide), _of_wide(spark, store, known)))


def _of_wide(spark: SparkSession, store: Store, known: DataFrame) -> DataFrame:
    keys = spark.table(store.wide).where(F.col(KEY).isNotNull()).select(F.col(KEY).alias("conv_id")).distinct()
    return known.join(keys, "conv_id", "left_semi")
