"""Queries running the ingest job on published entries."""

from __future__ import annotations

import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.operators.dedupe import first_wins
from callgauge.plans.sql_views import statement
from callgauge.plans.validation import BIG, FAULTS, SQL_FAULTS
from callgauge.session import scratch_dir
from callgauge.sources import bus, envelopes, views
from callgauge.streaming import ingest, live


class Run:
    """Folders of one job in the session's scratch folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        home = scratch_dir(spark, name)
        self.topic, self.sink, self.dead, self.checkpoint = (f"{home}/{part}" for part in ("topic", "logs", "dead", "checkpoint"))

    def publish(self, rows: DataFrame, offset: str = "stream_seq", partition: int = 0, dealt: bool = False) -> None:
        """In at least as many files as the session has cores; rows that are ``dealt`` lie in as many parts already."""
        entries = bus.to_entries(rows, offset, F.col("payload"), F.lit(partition))
        bus.publish(entries if dealt else entries.repartition(self.spark.sparkContext.defaultParallelism), self.topic)

    def entries(self) -> DataFrame:
        return bus.read_folder(self.spark, self.topic)

    def ingest(self, **options) -> None:
        ingest.start(self.entries(), self.sink, self.dead, self.checkpoint, **options).awaitTermination()

    def ingest_failing(self, stage: str) -> None:
        """A run that breaks off in its first batch."""

        def fail(_: int, reached: str) -> None:
            if reached == stage:
                raise RuntimeError("worker lost")

        try:
            self.ingest(on_batch=fail)
        except StreamingQueryException:
            return
        raise AssertionError("the run was meant to fail")

    def logs(self) -> DataFrame:
        return ingest.stored(self.spark, self.sink)


SHOWN = ("request_id", "conversation_id", "provider", "status", "latency_ms", "total_tokens", "input_preview", "pii_redacted", "metadata")


def _shown(run: Run) -> DataFrame:
    return run.logs().select(*SHOWN, F.col("requested_at").cast("timestamp_ntz").alias("requested_at"))


def stream_source(spark: SparkSession, folder: str) -> DataFrame:
    run = Run(spark, "stream_source")
    run.publish(views.delivered_envelopes(spark, folder))
    read = envelopes.parse(envelopes.entries_with_payload(run.entries()))
    rows = read.select("offset", F.try_variant_get("log", "$.requestId", "string").alias("request_id"))
    live.append(rows, run.sink, run.checkpoint).awaitTermination()
    return spark.read.parquet(run.sink)


def start_position(spark: SparkSession, folder: str) -> DataFrame:
    """A job for new entries only, made between two deliveries, and made again after them."""
    run = Run(spark, "start_position")
    sent = views.delivered_envelopes(spark, folder)
    run.publish(sent.where("stream_seq % 2 = 0"))
    position = bus.latest(spark, run.topic, run.checkpoint)
    time.sleep(1.1)  # file times may be whole seconds
    run.publish(sent.where("stream_seq % 2 = 1"))
    assert position == bus.latest(spark, run.topic, run.checkpoint)
    read = envelopes.parse(envelopes.entries_with_payload(bus.read_folder(spark, run.topic, after=position)))
    rows = read.select("offset", F.try_variant_get("log", "$.requestId", "string").alias("request_id"))
    live.append(rows, run.sink, f"{run.checkpoint}/stream").awaitTermination()
    return spark.read.parquet(run.sink)


def log_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Repeats within a delivery, then a second delivery of logs that are stored already; the table compacted between."""
    run = Run(spark, "log_sink")
    sent = views.delivered_envelopes(spark, folder, dealt=True)
    run.publish(sent, dealt=True)
    run.ingest()
    ingest.compact(spark, run.sink, keep=0)
    run.publish(sent.withColumn("stream_seq", F.col("stream_seq") + 10**12), dealt=True)
    run.ingest()
    return _shown(run)


def log_sink_resent(spark: SparkSession, folder: str) -> DataFrame:
    """Logs that were stored are sent again with a time of another day, and once more after the table was compacted."""
    run = Run(spark, "log_sink_resent")
    run.publish(views.delivered_envelopes(spark, folder, dealt=True), dealt=True)
    run.ingest()
    run.publish(views.resent_envelopes(spark, folder, days=1, dealt=True), dealt=True)
    run.ingest()
    ingest.compact(spark, run.sink, keep=0)
    run.publish(views.resent_envelopes(spark, folder, days=-2, dealt=True), dealt=True)
    run.ingest()
    return _shown(run)


def inserted_count(spark: SparkSession, folder: str) -> DataFrame:
    run = Run(spark, "inserted_count")
    run.publish(views.delivered_envelopes(spark, folder, dealt=True), dealt=True)
    run.ingest()
    return ingest.counts(spark, run.sink).groupBy().agg(
        *[F.sum(c).alias(c) for c in ("received", "rejected", "inserted", "duplicates")]
    )


def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.delivered(spark, folder).withColumn("latency_ms", F.expr("latency_ms + cast(stream_seq % 10 as int)"))
    return first_wins(rows, "request_id", "stream_seq").select("request_id", "stream_seq", "latency_ms")


def commit_after_write(spark: SparkSession, folder: str) -> DataFrame:
    """Broken off after the rows were written and before the batch was committed, then started again."""
    run = Run(spark, "commit_after_write")
    run.publish(views.delivered_envelopes(spark, folder, dealt=True), dealt=True)
    run.ingest_failing("written")
    run.ingest()
    return _shown(run)


def redeliver_stuck(spark: SparkSession, folder: str) -> DataFrame:
    """Broken off between reading and writing, then started again."""
    run = Run(spark, "redeliver_stuck")
    run.publish(views.delivered_envelopes(spark, folder, dealt=True), dealt=True)
    run.ingest_failing("read")
    run.ingest()
    return _shown(run)


def ingest_job(spark: SparkSession, folder: str) -> DataFrame:
    """Good, repeated, faulty and unreadable entries at once: what was stored, and why the rest was not.

    The faulty and the unreadable ones have the same offsets, in two partitions.
    """
    run = Run(spark, "ingest_job")
    run.publish(views.delivered_envelopes(spark, folder, dealt=True), dealt=True)
    faulty = views.faulty_envelopes(spark, folder, FAULTS, dealt=True)
    run.publish(faulty.selectExpr("event_id as stream_seq", "payload"), partition=1, dealt=True)
    torn = """element_at(array('null', substring(payload, 1, 60), concat(payload, '] tail'), concat(payload, ', ', payload),
        concat(payload, '],[', payload), concat(payload, '} x'), concat(payload, ' x')), cast(event_id % 7 + 1 as int)) as payload"""
    run.publish(views.envelopes(spark, folder, dealt=True).selectExpr("event_id as stream_seq", torn), partition=2, dealt=True)
    run.ingest()
    kept = run.logs().selectExpr("'stored' as verdict", "request_id as id", "input_preview", "pii_redacted")
    dead = spark.read.parquet(run.dead).selectExpr(
        "reason as verdict", "concat(partition, ':', offset) as id", "cast(null as string) as input_preview", "cast(null as boolean) as pii_redacted"
    )
    return kept.union(dead)


QUERIES = {
    "stream_source": stream_source,
    "start_position": start_position,
    "log_sink": log_sink,
    "log_sink_resent": log_sink_resent,
    "inserted_count": inserted_count,
    "dedupe_first": dedupe_first,
    "commit_after_write": commit_after_write,
    "redeliver_stuck": redeliver_stuck,
    "ingest_job": ingest_job,
}

PREVIEW = "input_preview || case event_id % 5 when 0 then ' from [EMAIL_REDACTED]' when 1 then ' at [IP_REDACTED]' else '' end"
STORED = f"""select request_id, '00000000-0000-4000-8000-' || lpad(lower(to_hex(conversation_id)), 12, '0') as conversation_id,
    provider, status, latency_ms, total_tokens, {PREVIEW} as input_preview, event_id % 5 in (0, 1) as pii_redacted,
    replace(metadata, ' ', '') as metadata, requested_at from logs"""
_N = len(FAULTS)

ORACLE = {
    "stream_source": statement("select stream_seq as offset, request_id from delivered"),
    "start_position": statement("select stream_seq as offset, request_id from delivered where stream_seq % 2 = 1"),
    "log_sink": statement(STORED),
    "log_sink_resent": statement(f"""{STORED} union all select 'new-' || event_id, '00000000-0000-4000-8000-' || lpad(lower(to_hex(conversation_id)), 12, '0'),
        provider, status, latency_ms, total_tokens, {PREVIEW}, event_id % 5 in (0, 1), replace(metadata, ' ', ''),
        requested_at + interval '1' day from logs where event_id % 13 = 0"""),
    "inserted_count": """select count(*) + count(*) filter (where event_id % 9 = 0) as received, cast(0 as bigint) as rejected,
        count(*) as inserted, count(*) filter (where event_id % 9 = 0) as duplicates from events""",
    "dedupe_first": statement("""select request_id, min(stream_seq) as stream_seq, cast(min_by(latency_ms + stream_seq % 10, stream_seq) as int) as latency_ms
        from delivered group by request_id"""),
    "commit_after_write": statement(STORED),
    "redeliver_stuck": statement(STORED),
    "ingest_job": statement(
        f"""select 'stored' as verdict, request_id as id, {PREVIEW} as input_preview, event_id % 5 in (0, 1) as pii_redacted from logs
        union all select 'invalid', '1:' || event_id, null, null from events join faults on n = event_id % {_N}
         where codes <> ''
        union all select 'out_of_range', '1:' || event_id, null, null from events where event_id % {_N} = {BIG[0]}
        union all select 'corrupt', '2:' || event_id, null, null from events""",
        faults=SQL_FAULTS,
    ),
}
