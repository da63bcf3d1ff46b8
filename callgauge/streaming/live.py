"""Live tables: aggregates kept up to date by a stream.

The dashboard's numbers come from counts per (minute, latency), the same the batch aggregates start from. The ingest job
keeps them next to the stored table (:func:`callgauge.streaming.ingest.minute_counts`); late rows count like any others.
Percentiles of a minute or of any run of minutes are exact and are taken when the
counts are read, so the work per call does not depend on the number of windows it belongs to.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from callgauge.operators import metrics, transcript
from callgauge.session import prepare
from callgauge.streaming import sink as files

POLL = "3 seconds"


def touches(messages: DataFrame) -> DataFrame:
    """Streaming ``updated_at`` per conversation: the time of its last message."""
    return messages.groupBy("conversation_id").agg(F.max("created_at").alias("updated_at"))


def conversations(events: DataFrame) -> DataFrame:
    """Streaming rows of the conversation table: :func:`callgauge.operators.transcript.state` kept in state.

    A conversation's state is one row: last known title, model and provider with their ``seq``, whether it was cancelled,
    first and last time. All of it is folded by ``seq`` and not by arrival, so late events, repeated ones and any cut into
    micro-batches give the same row. It has no expiry: an event may name any conversation there ever was.
    """
    return transcript.state(events)


def start(changes: DataFrame, sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Writes the groups every micro-batch changes."""
    prepare(changes.sparkSession)
    return (
        changes.writeStream.outputMode("update")
        .foreachBatch(lambda df, n: files.write_batch(df, n, sink))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def append(rows: DataFrame, sink: str, checkpoint: str, *partitions: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends every row of a stream exactly once."""
    prepare(rows.sparkSession)
    return (
        rows.writeStream.format("parquet")
        .partitionBy(*partitions)
        .option("checkpointLocation", checkpoint)
        .option("path", sink)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def compact(spark: SparkSession, sink: str, *keys: str, keep: int = 1) -> None:
    """Keeps the newest version of each group of a live table. To be run by its writer, between batches."""
    schema = files.read(spark, sink).schema
    files.compact(spark, sink, keep, schema, lambda df: files.newest(df, *keys))


def trailing(counts: DataFrame, as_of: datetime, presets: dict[str, int] | None = None) -> DataFrame:
    """KPI row per preset from minute counts. Windows start on a full minute."""
    minute = as_of.replace(second=0, microsecond=0)
    return metrics.by_preset(counts, minute, presets, "bucket", metrics.latency_histogram_sum)
