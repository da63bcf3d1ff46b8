"""The ingest job: bus entries to the stored log table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from callgauge.operators import metrics, redaction, validate
from callgauge.operators.dedupe import first_wins, not_stored, unique_stream
from callgauge.operators.once import once
from callgauge.schemas import INT_COLUMNS, LOG_TABLE
from callgauge.session import prepare
from callgauge.sources import envelopes
from callgauge.streaming import idindex, metaindex, panes, sink as files

SCOPES = ("index", "all", "date", "state")
MINUTES = (
    "bucket TIMESTAMP, latency_ms INT, calls BIGINT, errors BIGINT, cancelled BIGINT, tokens BIGINT, ttft_sum BIGINT, "
    "ttft_calls BIGINT, requested_date DATE, batch_id BIGINT"
)
#: Most dates of a batch that are named in the filter on the stored table; more are joined.
MAX_DATES = 400
COUNTS = "batch_id BIGINT, received BIGINT, rejected BIGINT, inserted BIGINT, duplicates BIGINT"

#: Called with the batch id and "read" or "written".
Listener = Callable[[int, str], None]


def classify(entries: DataFrame) -> DataFrame:
    """Entries as typed, redacted rows with the ``reason`` why a row cannot be stored (null if it can).

    Text that is no JSON object, envelopes that break a rule and numbers the INT columns cannot hold are kept with
    their payload for the dead-letter folder. Entries without a payload are dropped.
    """
    parsed = envelopes.parse(envelopes.entries_with_payload(entries), keep=True)
    read = validate.check(parsed, with_columns=True)
    # an issue without a path is about the whole entry: it is no object
    reason = (
        F.when(F.get("issues", F.lit(0))["path"] == "", F.lit("corrupt"))
        .when(F.size("issues") > 0, F.lit("invalid"))
        .when(validate.out_of_range(), F.lit("out_of_range"))
    )
    told = validate.first_issues(F.col("issues"))
    return redaction.apply(once(read.drop("log", "fields"), reason=reason).withColumn("issues", told))


def to_rows(good: DataFrame) -> DataFrame:
    """Rows of the stored table out of classified ones."""
    stamped = good.withColumns({"ingested_at": F.current_timestamp(), "requested_date": F.to_date("requested_at")})
    narrow = stamped.withColumns({c: F.col(c).cast("int") for c in INT_COLUMNS})
    return narrow.select(*LOG_TABLE.fieldNames())


def stored(spark: SparkSession, sink: str) -> DataFrame:
    """The log table. Predicates on ``requested_date`` select folders."""
    return files.read(spark, sink, T.StructType([*LOG_TABLE.fields, T.StructField(files.BATCH, T.LongType())]))


def counts(spark: SparkSession, sink: str) -> DataFrame:
    """Received, rejected, inserted and duplicate entries per batch, or per run of batches that were compacted.

    In the scope ``state`` copies are gone before they can be counted: received and duplicates are null.
    """
    return files.read(spark, f"{sink}_counts", COUNTS)


def minute_counts(spark: SparkSession, sink: str, as_of: datetime | None = None, minutes: float | None = None) -> DataFrame:
    """Counts per (minute, latency) of the stored table, kept by the job; with ``as_of`` those of the last ``minutes``.

    Every batch adds the counts of its new rows. They just add up, so late rows count like any others and no stream
    state is needed. They are stored by date, so a window reads the folders of its dates.
    """
    kept = files.read(spark, f"{sink}_minutes", MINUTES)
    if as_of is not None:
        kept = metrics.in_window(kept, as_of, minutes, "bucket")
    return metrics.latency_histogram_sum(kept, "bucket")


def with_metadata(spark: SparkSession, sink: str, part: str) -> DataFrame:
    """Stored logs whose metadata contains ``part`` (JSON text), out of the files that can hold such.

    Files the index does not know, all of them if there is none, are read whole.
    """
    return metaindex.lookup(spark, sink, f"{sink}_meta", part).rows


def compact(spark: SparkSession, sink: str, keep: int = 1) -> None:
    """Merges all but the last ``keep`` batches of the stored table, the minute counts and the batch counts.

    To be run by the sink's writer, between batches or while the job is stopped. The last batch may be one that was
    written and not yet committed; it will be overwritten and is left alone.
    """
    order = ("requested_date", "provider", "model", "requested_at")
    files.compact(spark, sink, keep, LOG_TABLE, lambda df: df.repartitionByRange(*order).sortWithinPartitions(*order), "requested_date")
    minutes = T.StructType.fromDDL(MINUTES)
    files.compact(spark, f"{sink}_minutes", keep, minutes, _sum_minutes, "requested_date")
    files.compact(spark, f"{sink}_counts", keep, T.StructType.fromDDL(COUNTS), _sum_counts)
    if files.exists(spark, f"{sink}_meta"):
        metaindex.refresh(spark, sink, f"{sink}_meta")


def _sum_minutes(rows: DataFrame) -> DataFrame:
    return metrics.latency_histogram_sum(rows, "requested_date", "bucket")


def _sum_counts(rows: DataFrame) -> DataFrame:
    """A sum over batches of which one is unknown is unknown."""
    names = [c for c in rows.columns if c != files.BATCH]
    return rows.agg(*[F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c) for c in names])


def write_new(
    batch: DataFrame,
    batch_id: int,
    sink: str,
    dead_letter: str,
    dedupe_scope: str = "index",
    on_batch: Listener | None = None,
    feed: str | None = None,
    index_metadata: bool = False,
) -> None:
    """Stores the rows of one micro-batch whose request id is new, and counts what became of the others.

    Next to the rows go their counts per minute, which the live dashboard is made of. What has no rows is not written; a
    replayed batch has the same ones.

    ``index`` compares with every stored id by way of filters (:mod:`callgauge.streaming.idindex`): a request is stored
    once whatever its time, and only files that may hold an id of the batch are read. It is brought up to date first if
    the table was kept in another scope until now. ``date`` compares with the stored ids of the dates in the batch, which is right as long as a repeated log keeps its
    request time, as producers that send the same object again see to. ``all`` compares with every stored id and scans
    that column of the whole table. ``state`` leaves it to the stream's own state.
    """
    spark = batch.sparkSession
    # only a rejected entry is stored with its payload, the others need not be held with it
    slim = batch.withColumn("payload", F.when(F.col("reason").isNotNull(), F.col("payload")))
    kept = slim.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if on_batch:
            on_batch(batch_id, "read")
        received, n_good = kept.agg(F.count("*"), F.count_if(F.col("reason").isNull())).first()
        if received > n_good:
            rejected = kept.where("reason is not null").select("partition", "offset", "payload", "reason", "issues")
            files.write_batch(rejected, batch_id, dead_letter)
        good = kept.where("reason is null")
        fresh = to_rows(first_wins(good, "request_id", "offset", "partition"))
        if dedupe_scope != "state" and n_good and files.exists(spark, sink):
            # a replayed batch must not find its own rows
            known = stored(spark, sink).where(F.col(files.BATCH) != batch_id)
            if dedupe_scope == "index":
                idindex.cover(spark, f"{sink}_ids", sink, "request_id", batch_id)
                known = idindex.lookup(spark, f"{sink}_ids", good, "request_id", n_good, batch_id).ids
            if dedupe_scope == "date":
                known = _of_dates(known, good.select(F.to_date("requested_at").alias("requested_date")).distinct())
            if known is not None:
                fresh = not_stored(fresh, known, "request_id", n_good)
        inserted = 0
        if n_good:
            written = Observation()
            # in the order of the access paths, so that row groups can be skipped by their bounds
            ordered = fresh.sortWithinPartitions("requested_date", "provider", "model", "requested_at")
            files.write_batch(ordered.observe(written, F.count("*").alias("rows")), batch_id, sink, "requested_date")
            inserted = written.get["rows"]
            if dedupe_scope == "index":
                ids = spark.read.schema(LOG_TABLE).parquet(f"{sink}/{files.BATCH}={batch_id}").select("request_id")
                idindex.add(ids, f"{sink}_ids", batch_id, batch_id, inserted)
                idindex.merge(spark, f"{sink}_ids", batch_id)
        if inserted:
            # read back rather than computed again: one column-pruned scan of the new files
            new_rows = spark.read.schema(LOG_TABLE).parquet(f"{sink}/{files.BATCH}={batch_id}")
            minutes = metrics.latency_histogram(metrics.bucketed(new_rows), "requested_date", "bucket")
            files.write_batch(minutes, batch_id, f"{sink}_minutes", "requested_date")
            if feed:
                # one column-pruned scan of what was just written
                panes.feed(files.read(spark, f"{sink}_minutes/{files.BATCH}={batch_id}", MINUTES), batch_id, feed)
            if index_metadata:
                metaindex.add(spark, sink, f"{sink}_meta", batch_id)
        known_copies = dedupe_scope != "state"
        row = [(batch_id, received if known_copies else None, received - n_good, inserted, n_good - inserted if known_copies else None)]
        files.write_batch(spark.createDataFrame(row, COUNTS).drop("batch_id").coalesce(1), batch_id, f"{sink}_counts")
        if on_batch:
            on_batch(batch_id, "written")
    finally:
        kept.unpersist()


def _of_dates(stored_rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Stored rows of the dates: by a filter that selects folders, or if there are very many by a join that does."""
    some = [r[0] for r in dates.limit(MAX_DATES + 1).collect()]
    if len(some) <= MAX_DATES:
        return stored_rows.where(F.col("requested_date").isin(some))
    return stored_rows.join(dates, "requested_date", "left_semi")


def start(
    entries: DataFrame,
    sink: str,
    dead_letter: str,
    checkpoint: str,
    trigger: dict | None = None,
    dedupe_scope: str = "index",
    on_batch: Listener | None = None,
    feed: str | None = None,
    index_metadata: bool = False,
) -> StreamingQuery:
    """Runs the job on a stream of bus entries. One writer per sink. Settings that results depend on are set on the session.

    A batch counts as consumed once its rows are written; whatever fails before is read again. ``trigger`` holds the
    arguments of ``DataStreamWriter.trigger``, by default everything there is and then stop. ``feed`` is a folder the counts
    per minute of new rows go to as well, for :mod:`callgauge.streaming.panes`. ``index_metadata`` keeps the index that
    :func:`with_metadata` uses.
    """
    if dedupe_scope not in SCOPES:
        raise ValueError(f"dedupe_scope must be one of {SCOPES}")
    prepare(entries.sparkSession)
    rows = classify(entries)
    if dedupe_scope == "state":
        # rejected entries have no id to compare and go round the state
        rows = unique_stream(rows.where("reason is null"), "request_id", "offset").unionByName(rows.where("reason is not null"))
    return (
        rows.writeStream.foreachBatch(lambda df, n: write_new(df, n, sink, dead_letter, dedupe_scope, on_batch, feed, index_metadata))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
