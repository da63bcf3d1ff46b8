"""Queries running the live tables on published entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.functions.numbers import MAX_MINUTES
from callgauge.operators import metrics
from callgauge.plans.chunks import ORACLE as CHUNK_SQL
from callgauge.plans.ingest import Run
from callgauge.plans.metrics import KPI, ORACLE as METRIC_SQL
from callgauge.plans.sql_views import statement
from callgauge.sources import views
from callgauge.streaming import ingest, live, panes, replies, sink


def _halves(rows: DataFrame) -> list[DataFrame]:
    """The rows up to the middle of their time span, and those after it."""
    first, last = rows.agg(F.min("requested_at"), F.max("requested_at")).first()
    middle = F.lit((first + (last - first) / 2).isoformat(sep=" ")).cast("timestamp_ntz")
    return [rows.where(F.col("requested_at") < middle), rows.where(F.col("requested_at") >= middle)]


def _ntz(rows: DataFrame, column: str = "bucket") -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("timestamp_ntz"))


def minute_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """The minutes as the job keeps them, newest half first, compacted at the end."""
    run = Run(spark, "minute_tumbling")
    for half in reversed(_halves(views.delivered_envelopes(spark, folder, dealt=True))):
        run.publish(half, dealt=True)
        run.ingest()
    ingest.compact(spark, run.sink, keep=0)
    return metrics.series_of(_ntz(ingest.minute_counts(spark, run.sink)))


def poll_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """The ingest job on a clock, the series read from the counts it keeps."""
    run = Run(spark, "poll_refresh")
    run.publish(views.delivered_envelopes(spark, folder, dealt=True), dealt=True)
    query = ingest.start(run.entries(), run.sink, run.dead, run.checkpoint, {"processingTime": live.POLL})
    query.processAllAvailable()
    query.stop()
    return metrics.series_of(_ntz(ingest.minute_counts(spark, run.sink)))


def trailing_window(spark: SparkSession, folder: str) -> DataFrame:
    """The presets out of the kept counts."""
    run = Run(spark, "trailing_window")
    for half in _halves(views.delivered_envelopes(spark, folder, dealt=True)):
        run.publish(half, dealt=True)
        run.ingest()
    as_of = metrics.latest(views.logs(spark, folder))
    # a minute more than the widest preset, whose window starts on a full minute
    return live.trailing(_ntz(ingest.minute_counts(spark, run.sink, as_of, MAX_MINUTES + 1)), as_of)


def late_data(spark: SparkSession, folder: str) -> DataFrame:
    """Newest logs first, so that half of them are later than any watermark: kept counts and stored table have all."""
    run = Run(spark, "late_data")
    for half in reversed(_halves(views.delivered_envelopes(spark, folder, dealt=True))):
        run.publish(half, dealt=True)
        run.ingest()
    kept = metrics.series_of(ingest.minute_counts(spark, run.sink))
    stored = metrics.series(run.logs()).selectExpr("bucket", "requests as stored_requests", "p95 as stored_p95")
    return _ntz(kept.join(stored, "bucket", "full"))


def _with_panes(spark: SparkSession, folder: str, name: str) -> tuple[Run, str]:
    """The job and the state behind it, newest half first, so that most of the other half is late."""
    run = Run(spark, name)
    feed, kept = f"{run.topic}_feed", f"{run.sink}_panes"
    for half in reversed(_halves(views.delivered_envelopes(spark, folder, dealt=True))):
        run.publish(half, dealt=True)
        run.ingest(feed=feed)
        panes.start(spark, feed, kept, f"{run.checkpoint}_panes").awaitTermination()
    return run, kept


def minute_panes(spark: SparkSession, folder: str) -> DataFrame:
    """Minutes out of the state, those with late rows out of the kept counts, and how many rows were late."""
    run, kept = _with_panes(spark, folder, "minute_panes")
    found = panes.minutes(spark, kept, ingest.minute_counts(spark, run.sink)).join(panes.late(spark, kept), "bucket", "left")
    return _ntz(found).select("bucket", "requests", "errors", "p95", F.coalesce("late", F.lit(0)).alias("late"))


def trailing_panes(spark: SparkSession, folder: str) -> DataFrame:
    """Every window of 15 minutes, moving by one."""
    run, kept = _with_panes(spark, folder, "trailing_panes")
    return _ntz(panes.windows(spark, kept, ingest.minute_counts(spark, run.sink)))


#: Nested objects, and an array one element of which has to hold both keys.
TAGGED = '{"call": {"tier": "gold"}, "tags": [{"kind": "status", "value": "error"}], "tries": [3.0]}'


def metadata_contains(spark: SparkSession, folder: str) -> DataFrame:
    """Containment by the index the job keeps: one half compacted, the other as it came."""
    run = Run(spark, "metadata_contains")
    for half in _halves(views.tagged_envelopes(spark, folder)):
        ingest.compact(spark, run.sink, keep=0)
        run.publish(half)
        run.ingest(index_metadata=True)
    return _ntz(ingest.with_metadata(spark, run.sink, TAGGED), "requested_at").select("request_id", "provider", "requested_at")


LINE = "call_id BIGINT, seq BIGINT, data STRING, arrived_at TIMESTAMP"


def reassemble_live(spark: SparkSession, folder: str) -> DataFrame:
    """Replies out of chunks as they arrive, in four deliveries that calls are spread over, and then a line long after."""
    run = Run(spark, "reassemble_live")
    lines = views.arriving_lines(spark, folder)
    first, last = lines.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    edges = [F.lit((first + (last - first) * k / 4).isoformat(sep=" ")).cast("timestamp_ntz") for k in range(5)]
    for k in range(4):
        upto = F.col("arrived_at") < edges[k + 1] if k < 3 else F.lit(True)
        lines.where((F.col("arrived_at") >= edges[k]) & upto).repartition(1).write.mode("append").json(run.topic)
    after = spark.sql(f"select -1L as call_id, 0L as seq, '' as data, timestamp'{last}' + interval '1' day as arrived_at")
    after.write.mode("append").json(run.topic)
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).json(run.topic)
    replies.start(stream, "completions", run.sink, run.checkpoint).awaitTermination()
    return replies.stored(spark, run.sink).where("call_id >= 0")


MESSAGE = "conversation_id BIGINT, turn BIGINT, role STRING, content STRING, token_count INT, created_at TIMESTAMP"


def _message_stream(spark: SparkSession, run: Run, folder: str) -> DataFrame:
    views.messages(spark, folder).write.json(run.topic)
    return spark.readStream.schema(MESSAGE).json(run.topic)


def message_append(spark: SparkSession, folder: str) -> DataFrame:
    run = Run(spark, "message_append")
    rows = _message_stream(spark, run, folder).withColumn("created_date", F.to_date("created_at"))
    live.append(rows, run.sink, run.checkpoint, "created_date").awaitTermination()
    kept = spark.read.parquet(run.sink)
    return kept.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def conversation_touch(spark: SparkSession, folder: str) -> DataFrame:
    run = Run(spark, "conversation_touch")
    live.start(live.touches(_message_stream(spark, run, folder)), run.sink, run.checkpoint).awaitTermination()
    current = sink.newest(sink.read(spark, run.sink), "conversation_id")
    return current.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


EVENT = "conv_id BIGINT, seq BIGINT, kind STRING, title STRING, provider STRING, event_at TIMESTAMP"


def conversation_live(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations folded from their events as these come, in no order: four deliveries, each of them one micro-batch."""
    run = Run(spark, "conversation_live")
    events = views.conversation_events(spark, folder).withColumn("part", F.pmod(F.xxhash64("conv_id", "seq"), F.lit(4)))
    for part in (3, 1, 0, 2):
        events.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").json(run.topic)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(run.topic)
    live.start(live.conversations(stream), run.sink, run.checkpoint).awaitTermination()
    current = sink.newest(sink.read(spark, run.sink), "conv_id")
    return current.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


QUERIES = {
    "minute_tumbling": minute_tumbling,
    "poll_refresh": poll_refresh,
    "trailing_window": trailing_window,
    "late_data": late_data,
    "minute_panes": minute_panes,
    "trailing_panes": trailing_panes,
    "metadata_contains": metadata_contains,
    "reassemble_live": reassemble_live,
    "message_append": message_append,
    "conversation_touch": conversation_touch,
    "conversation_live": conversation_live,
}

ORACLE = {
    "minute_tumbling": METRIC_SQL["series_minute"],
    "poll_refresh": METRIC_SQL["series_minute"],
    "trailing_window": statement(
        " union all ".join(
            f"select '{name}' as preset, {m} as minutes, {', '.join(f'{sql} as {n}' for n, sql in KPI.items()).replace('cast(1440 as', f'cast({m} as')} from logs "
            f"where requested_at >= (select date_trunc('minute', max(requested_at)) from logs) - interval '{m}' minute"
            for name, m in metrics.WINDOW_PRESETS.items()
        )
    ),
    "late_data": f"select *, requests as stored_requests, p95 as stored_p95 from ({METRIC_SQL['series_minute']}) s",
    "minute_panes": statement(f"""select s.*, case when bucket + interval '1441' minute <= (select date_trunc('minute', max(requested_at)) from logs)
          and bucket < (select min(requested_at) + (max(requested_at) - min(requested_at)) / 2 from logs) then requests - coalesce(young, 0) else 0 end as late
        from ({METRIC_SQL['series_minute']}) s left join (
          select date_trunc('minute', requested_at) as bucket, count(*) as young from logs
           where requested_at >= (select min(requested_at) + (max(requested_at) - min(requested_at)) / 2 from logs) group by 1) y using (bucket)"""),
    "trailing_panes": statement(f"""select date_trunc('minute', requested_at) + k * interval '1' minute as bucket, count(*) as requests,
          {KPI['errors']} as errors, {KPI['p50_ms']} as p50, {KPI['p95_ms']} as p95
        from logs, (select unnest(range(15)) as k) group by 1"""),
    "metadata_contains": statement(
        """select request_id, provider, requested_at from tagged where json_extract_string(m, '$.call.tier') = 'gold'
          and list_contains(cast(json_extract(m, '$.tags') as struct(kind varchar, value varchar)[]), {'kind': 'status', 'value': 'error'})
          and list_contains(cast(json_extract(m, '$.tries') as double[]), 3)""",
        tagged="""select request_id, provider, requested_at, json_object('call', json_object('tier', case when event_id % 3 = 0 then 'gold' else 'free' end),
            'tags', json_array(json_object('kind', 'status', 'value', status), json_object('kind', 'provider', 'value', provider)),
            'tries', json_array(1, event_id % 4)) as m from logs""",
    ),
    # what follows an end marker that is not there belongs to the text
    "reassemble_live": f"""select call_id, case when call_id % 7 = 0 then 'unfinished' else 'complete' end as outcome,
        case when call_id % 7 = 0 then text || 'late' else text end as text, finish_reason, usage_prompt, usage_completion, usage_total
        from ({CHUNK_SQL['reassemble_openai']}) s""",
    "message_append": statement("""select conversation_id, turn, role, content, cast(null as int) as token_count, created_at,
        cast(created_at as date) as created_date from messages"""),
    "conversation_live": statement("select conv_id, title, provider, status, created_at, updated_at from state"),
    "conversation_touch": statement("select conversation_id, max(created_at) as updated_at from messages group by conversation_id"),
}
