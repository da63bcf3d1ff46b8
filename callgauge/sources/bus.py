"""The event bus between producers and the ingest job: a folder of JSON lines, or Kafka.

A bus entry is known by its ``partition`` and ``offset``; copies of a log share a partition, so the offset orders them.
``fields`` is a flat list of names and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from callgauge.sources.envelopes import PAYLOAD
from callgauge.streaming.sink import exists

ENTRY = "partition INT, offset BIGINT, fields ARRAY<STRING>"
STARTS = ("earliest", "latest")
#: Most entries in a file of the folder.
PER_FILE = 20_000


def to_entries(rows: DataFrame, offset: str, payload: Column, partition: Column | None = None) -> DataFrame:
    number = F.lit(0) if partition is None else partition
    return rows.select(
        number.cast("int").alias("partition"), F.col(offset).alias("offset"), F.array(F.lit(PAYLOAD), payload).alias("fields")
    )


def publish(entries: DataFrame, folder: str) -> None:
    """Compressed, in files that one task reads."""
    entries.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).json(folder)


def read_folder(spark: SparkSession, folder: str, max_files: int | None = None, after: int | None = None) -> DataFrame:
    """Streaming read of published entries; ``max_files`` bounds a micro-batch.

    ``after`` (see :func:`latest`) leaves out files published up to then.
    """
    reader = spark.readStream.schema(ENTRY)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    entries = reader.json(folder)
    if after is None:
        return entries
    return entries.where(F.unix_millis("_metadata.file_modification_time") > after)


def latest(spark: SparkSession, folder: str, home: str) -> int:
    """The newest publication in a folder, in ms: where a job that wants new entries only starts.

    It is noted in ``home`` (the job's checkpoint) when first asked for, and a restarted job gets the same answer.
    """
    note = f"{home}/start_position"
    if not exists(spark, note):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(folder) if exists(spark, folder) else None
        newest = files.agg(F.max(F.unix_millis("modificationTime"))).first()[0] if files is not None else None
        spark.range(1).select(F.lit(newest or 0).cast("string")).coalesce(1).write.text(note)
    return int(spark.read.text(note).first()[0])


def kafka_options(servers: str, topic: str, start: str = "earliest", max_offsets: int | None = None) -> dict[str, str]:
    """Reader options. A new job starts with the oldest entry, so that nothing published before it is lost;
    ``latest`` skips what is there already."""
    if start not in STARTS:
        raise ValueError(f"start must be one of {STARTS}")
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start}
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_kafka(spark: SparkSession, **options) -> DataFrame:
    """Entries of a topic whose records are keyed by request id: copies share a partition, so offsets order them."""
    records = spark.readStream.format("kafka").options(**kafka_options(**options)).load()
    return to_entries(records, "offset", F.col("value").cast("string"), F.col("partition"))
