"""Log, transcript and call tables derived from the driver's tables.

``events`` plays one model call per row and ``conversations`` one chat message per row. The mapping is plain
projection, so filters and column pruning reach the Parquet scan through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.operators.chunks import join_text
from callgauge.operators.hotkeys import next_value
from callgauge.sources.envelopes import to_payload
from callgauge.sources.tables import table

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def logs(spark: SparkSession, folder: str, *extra: str, dealt: bool = False) -> DataFrame:
    """One row per call; ``extra`` keeps columns of ``events`` next to it. ``dealt`` spreads them over all cores first."""
    events = table(spark, folder, "events")
    if dealt:
        events = events.repartition(spark.sparkContext.defaultParallelism)
    return events.selectExpr(
        *extra,
        "concat('evt-', cast(event_id as string)) as request_id",
        "user_id as conversation_id",
        "case user_id % 4 when 0 then 'anthropic' when 1 then 'openai' when 2 then 'gemini' else 'mock' end as provider",
        "case when event_id % 2 = 0 then 'large' else 'small' end as model",
        "event_type <> 'view' as streaming",
        "case event_type when 'error' then 'error' when 'signup' then 'cancelled' else 'success' end as status",
        "case when event_type = 'error' then case event_id % 3 when 0 then 'rate_limit' when 1 then 'provider_5xx'"
        " else 'provider_4xx' end end as error_type",
        "cast(floor(value * 10) as int) as latency_ms",
        "case when event_type in ('click', 'purchase', 'signup') then cast(floor(value * 3) as int) end as ttft_ms",
        "case when event_type in ('click', 'purchase', 'view') then cast(floor(value * 7) as int) end as total_tokens",
        "event_id % 11 = 0 as pii_redacted",
        "concat(event_type, ' ', props) as input_preview",
        "case when event_type <> 'error' then concat('value ', cast(cast(floor(value) as int) as string)) end as output_preview",
        "ts as requested_at",
        "ts + make_dt_interval(0, 0, 0, event_id % 5) as ingested_at",
        "cast(ts as date) as requested_date",
        "props as metadata",
    )


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """At-least-once delivery: every ninth log arrives twice."""
    offsets = F.expr("explode(if(event_id % 9 = 0, array(0, 7), array(0)))")
    sent = logs(spark, folder, "event_id").withColumn("copy", offsets)
    return sent.withColumn("stream_seq", F.expr("event_id * 10 + copy")).drop("event_id", "copy")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript rows. The stored time is the order of turns, one second apart."""
    return table(spark, folder, "conversations").selectExpr(
        "conv_id as conversation_id",
        "turn",
        "role",
        "text as content",
        f"{EPOCH} + make_dt_interval(0, 0, 0, conv_id * 100 + turn) as created_at",
    )


def conversation_events(spark: SparkSession, folder: str) -> DataFrame:
    """Create, message, meta and cancel events; ``seq`` orders them within a conversation.

    One scan without the texts makes all events but the titles, which come from a second one.
    """
    turns = table(spark, folder, "conversations")
    happened = turns.selectExpr(
        "conv_id",
        """inline(filter(array(
          if(turn = 0, named_struct('seq', 0L, 'kind', 'create', 'provider', cast(null as string)), null),
          named_struct('seq', turn * 10 + 1, 'kind', 'message', 'provider', cast(null as string)),
          if(role = 'user', named_struct('seq', turn * 10 + 3, 'kind', 'meta', 'provider',
            case (conv_id + turn) % 3 when 0 then 'openai' when 1 then 'anthropic' else 'mock' end), null),
          if(turn = 0 and conv_id % 7 = 0, named_struct('seq', 1000L, 'kind', 'cancel', 'provider', cast(null as string)), null)
        ), e -> e is not null))""",
    ).selectExpr("conv_id", "seq", "kind", "cast(null as string) as title", "provider")
    first = turns.where("role = 'user'").selectExpr("conv_id", "turn", "substring(text, 1, 60) as title")
    titled = first.groupBy("conv_id").agg(F.min("turn").alias("turn"), F.min_by("title", "turn").alias("title")).selectExpr(
        "conv_id", "turn * 10 + 2 as seq", "'meta' as kind", "title", "cast(null as string) as provider"
    )
    return happened.union(titled).withColumn(
        "event_at", F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, conv_id * 3600 + seq)")
    )


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Raw calls: one per user turn, with errors, aborts and missing usage; the reply is the next turn's text."""
    turns = table(spark, folder, "conversations").withColumn("k", F.expr("conv_id * 100 + turn"))
    replied = next_value(turns, "conv_id", "turn", "text", "output")
    return replied.where("role = 'user'").selectExpr(
        "concat('call-', cast(k as string)) as request_id",
        "k as call_id",
        "conv_id",
        "turn",
        "text as last_user",
        "output",
        "case when k % 10 in (0, 1, 2, 3, 4) then case k % 10 when 3 then 'AbortError' else 'Error' end end as err_name",
        "case k % 10 when 0 then 429 when 1 then 503 when 2 then 400 end as http_status",
        "case when k % 2 = 0 then 50 + k % 17 end as usage_prompt",
        "case when k % 3 <> 0 then 20 + k % 11 end as usage_completion",
        "case when k % 4 = 0 then 100 end as usage_total",
        f"{EPOCH} + make_dt_interval(0, 0, 0, k) as started_at",
        f"{EPOCH} + make_dt_interval(0, 0, 0, k + 1 + k % 7) as ended_at",
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Streamed deltas: one row per word of an assistant turn."""
    return (
        table(spark, folder, "conversations")
        .where("role = 'assistant'")
        .selectExpr("conv_id * 100 + turn as call_id", "posexplode(split(text, ' ')) as (seq, w)")
        .selectExpr("call_id", "seq", "if(seq = 0, w, concat(' ', w)) as delta")
    )


def raw_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls in the shape :mod:`callgauge.operators.calls` reads."""
    return calls(spark, folder).selectExpr(
        "request_id",
        "call_id",
        "conv_id as conversation_id",
        "cast(null as string) as message_id",
        "case conv_id % 4 when 0 then 'anthropic' when 1 then 'openai' when 2 then 'gemini' else 'mock' end as provider",
        "case when turn % 4 < 2 then 'large' else 'small' end as model",
        "call_id % 3 <> 0 as streaming",
        "array(named_struct('role', 'system', 'content', 'answer briefly'),"
        " named_struct('role', 'user', 'content', last_user)) as messages",
        "output",
        "err_name",
        "cast(null as string) as err_code",
        "case when err_name = 'AbortError' then 'aborted' when err_name = 'Error' and http_status is null"
        " then concat('lost connection: ', last_user) end as err_message",
        "http_status",
        "case when http_status is not null then last_user end as err_body",
        "case call_id % 3 when 0 then 'stop' when 1 then 'length' end as finish_reason",
        "if(call_id % 20 = 7, 0, usage_prompt) as usage_prompt",
        "if(call_id % 20 = 7, 0, usage_completion) as usage_completion",
        "usage_total",
        "case when call_id % 20 = 15 then true end as usage_estimated",
        "started_at",
        "case when output is not null then started_at + make_dt_interval(0, 0, 0, (72 + 40 * (call_id % 5)) / 1000) end"
        " as first_delta_at",
        "ended_at",
        "case when call_id % 6 = 0 then '{\"surface\":\"chat\",\"finishReason\":\"mine\"}' else '{\"surface\":\"chat\"}' end"
        " as metadata",
    )


def timed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Deltas with their arrival, 18 ms apart."""
    return chunks(spark, folder).withColumn(
        "arrived_at", F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, call_id - 1 + (72 + 18 * seq) / 1000)")
    )


def arriving_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the completions dialect 40 seconds apart, so that many calls are under way at once; every seventh call breaks
    off before its end marker, and lines of every fifth are sent again three minutes later."""
    sent = completion_lines(spark, folder).where("call_id % 7 <> 0 or data <> '[DONE]'")
    again = F.expr("explode(if(call_id % 5 = 0, array(0, 180), array(0)))")
    return sent.withColumn("again", again).selectExpr(
        "call_id", "seq", "data", f"{EPOCH} + make_dt_interval(0, 0, 0, call_id + 40 * seq + again) as arrived_at"
    )


def completion_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The deltas as ``data`` lines of the completions dialect: noise, deltas, finish, usage, end marker, leftovers."""
    words = chunks(spark, folder)
    delta = words.selectExpr(
        "call_id", "seq + 1 as seq",
        "to_json(named_struct('choices', array(named_struct('delta', named_struct('content', delta))))) as data",
    )
    tail = words.groupBy("call_id").agg((F.max("seq") + 2).alias("end")).selectExpr(
        "call_id",
        """inline(array(
          struct(0L as seq, '{"choices":[{"delta":{"content":"no"}}]} x' as data),
          struct(end as seq, '{"choices":[{"delta":{},"finish_reason":"stop"}]}' as data),
          struct(end + 1 as seq, concat('{"choices":[],"usage":{"prompt_tokens":', call_id, ',"completion_tokens":', end,
            ',"total_tokens":', call_id + end, '}}') as data),
          struct(end + 2 as seq, '[DONE]' as data),
          struct(end + 3 as seq, '{"choices":[{"delta":{"content":"late"}}]}' as data)))""",
    )
    return delta.union(tail)


def message_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same deltas as typed events of the messages dialect."""
    words = chunks(spark, folder)
    delta = words.selectExpr(
        "call_id", "seq + 1 as seq",
        "to_json(named_struct('type', 'content_block_delta', 'delta', named_struct('type', 'text_delta', 'text', delta))) as data",
    )
    tail = words.groupBy("call_id").agg((F.max("seq") + 2).alias("end")).selectExpr(
        "call_id",
        """inline(array(
          struct(0L as seq, concat('{"type":"message_start","message":{"usage":{"input_tokens":', call_id, '}}}') as data),
          struct(end as seq, 'ping' as data),
          struct(end + 1 as seq, concat('{"type":"message_delta","delta":{"stop_reason":"end_turn"},"usage":{"output_tokens":',
            end, '}}') as data),
          struct(end + 2 as seq, '{"type":"message_stop"}' as data)))""",
    )
    return delta.union(tail)


def captured_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Whole response bodies as captured text, each ending in an unfinished line."""
    lines = completion_lines(spark, folder).selectExpr("call_id", "seq", "concat('data: ', data, '\\r\\n\\n') as line")
    return join_text(lines, "call_id", "seq", "line", "", "body").selectExpr(
        "call_id", "concat(': stream\\n', body, 'data: {\"unfinished\"') as body"
    )


def event_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Browser-side event streams: a meta frame, one delta per word, a frame without JSON, and done."""
    words = chunks(spark, folder)
    frame = words.selectExpr(
        "call_id", "seq + 1 as seq", "concat('event: delta\\ndata: ', to_json(named_struct('text', delta)), '\\n\\n') as frame"
    )
    ends = words.groupBy("call_id").agg((F.max("seq") + 2).alias("end")).selectExpr(
        "call_id",
        """inline(array(
          struct(0L as seq, 'event: meta\\ndata: {"model":"m",\\ndata: "provider":"p"}\\n\\n' as frame),
          struct(end as seq, 'data: no json\\n\\nevent: empty\\n\\n' as frame),
          struct(end + 1 as seq, 'data: {"text":"plain"}\\n\\nevent: done\\ndata: {}' as frame)))""",
    )
    return join_text(frame.union(ends), "call_id", "seq", "frame", "", "body")


def uuid_of(number: str) -> str:
    """A UUID spelling of a whole number."""
    return f"concat('00000000-0000-4000-8000-', lpad(lower(hex({number})), 12, '0'))"


def sent_logs(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    """Logs as the producer sends them: typed rows with ``event_id``, personal data in some previews."""
    return logs(spark, folder, "event_id", dealt=dealt).selectExpr(
        "event_id",
        "request_id",
        f"{uuid_of('conversation_id')} as conversation_id",
        "provider",
        "model",
        "streaming",
        "status",
        "error_type",
        "latency_ms",
        "ttft_ms",
        "total_tokens",
        "concat(input_preview, case event_id % 5 when 0 then ' from me@x.io' when 1 then ' at 8.8.8.8' else '' end) as input_preview",
        "output_preview",
        "requested_at",
        "case when event_id % 3 <> 0 then requested_at + make_dt_interval(0, 0, 0, latency_ms / 1000) end as completed_at",
        "metadata",
    )


def envelopes(spark: SparkSession, folder: str, dealt: bool = False) -> DataFrame:
    """``event_id`` and the envelope JSON of every log."""
    sent = sent_logs(spark, folder, dealt)
    return sent.select("event_id", "requested_at", to_payload(sent).alias("payload"))


def delivered_envelopes(spark: SparkSession, folder: str, *, exact: bool = False, dealt: bool = False) -> DataFrame:
    """Every ninth envelope arrives twice; unless ``exact``, the second copy claims another latency."""
    sent = sent_logs(spark, folder, dealt).withColumn("copy", F.expr("explode(if(event_id % 9 = 0, array(0, 7), array(0)))"))
    if not exact:
        sent = sent.withColumn("latency_ms", F.expr("latency_ms + copy"))
    return sent.select("event_id", "requested_at", F.expr("event_id * 10 + copy as stream_seq"), to_payload(sent).alias("payload"))


def resent_envelopes(spark: SparkSession, folder: str, days: int, dealt: bool = False) -> DataFrame:
    """Every envelope once more, ``days`` later and with another latency; some also under a new id."""
    sent = sent_logs(spark, folder, dealt).withColumn("requested_at", F.expr(f"requested_at + interval '{days}' day"))
    new = sent.where("event_id % 13 = 0").withColumn("request_id", F.expr("concat('new-', event_id)"))
    both = sent.withColumn("latency_ms", F.expr("latency_ms + 1")).unionByName(new)
    number = F.expr(f"event_id * 10 + if(request_id like 'new-%', 1, 0) + {100 + days} * 1000000000000")
    return both.select("event_id", "requested_at", number.alias("stream_seq"), to_payload(both).alias("payload"))


def faulty_envelopes(
    spark: SparkSession, folder: str, faults: list[tuple[str, str | None, str]], dealt: bool = False
) -> DataFrame:
    """Every envelope with one key set to another JSON value (None takes it out), going through ``faults`` in turn."""
    listed = F.array(
        *[F.struct(F.lit(key).alias("key"), F.lit(value).cast("string").alias("value")) for key, value, _ in faults]
    )
    turn = (F.col("event_id") % len(faults)).cast("int")
    whole = F.try_variant_get(F.parse_json("payload"), "$", "map<string,variant>")
    without = F.to_json(F.map_filter(whole, lambda k, _: k != F.col("_fault.key")))
    # of a repeated key the last value counts
    ended = F.concat(F.lit(',"'), F.col("_fault.key"), F.lit('":'), F.col("_fault.value"), F.lit("}"))
    changed = F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), ended)
    broken = envelopes(spark, folder, dealt).withColumn("_fault", F.get(listed, turn))
    return broken.select("event_id", F.when(F.col("_fault.value").isNull(), without).otherwise(changed).alias("payload"))


def priced_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Logs with their tokens split into prompt and completion; every seventeenth has no provider that prices know."""
    return logs(spark, folder, "event_id").selectExpr(
        "request_id", "if(event_id % 17 = 0, 'other', provider) as provider", "model", "status", "requested_at",
        "total_tokens div 3 as prompt_tokens", "total_tokens - total_tokens div 3 as completion_tokens",
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """Two logs of ten change their model's price when they are requested, and once more 20 seconds later."""
    return logs(spark, folder, "event_id").where("event_id % 10 in (5, 8)").selectExpr(
        "provider", "model",
        "inline(array(struct(requested_at as valid_from, 100000 + event_id * 7 as prompt_price, 300000 + event_id as completion_price),"
        " struct(requested_at + interval '20' second as valid_from, 90000 + event_id * 3 as prompt_price, 250000 + event_id as completion_price)))",
    )


def tagged_envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Envelopes whose metadata has objects and arrays in it."""
    nested = """to_json(named_struct(
      'call', named_struct('tier', if(event_id % 3 = 0, 'gold', 'free'), 'k', get_json_object(metadata, '$.k')),
      'tags', array(named_struct('kind', 'status', 'value', status), named_struct('kind', 'provider', 'value', provider)),
      'tries', array(1, event_id % 4)))"""
    sent = sent_logs(spark, folder).withColumn("metadata", F.expr(nested))
    return sent.select("event_id", "requested_at", F.expr("event_id * 10 as stream_seq"), to_payload(sent).alias("payload"))


def batches(rows: DataFrame, size: int | None = None, *, by: str | None = None) -> DataFrame:
    """``size`` consecutive payloads, or those with the same value of the expression ``by``, as one batch text."""
    listed = rows.groupBy(F.expr(by or f"event_id div {size}").alias("batch_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("event_id", "payload"))), lambda r: r["payload"]
        ).alias("_logs")
    )
    body = F.concat(F.lit('{"logs":['), F.array_join("_logs", ","), F.lit("]}"))
    return listed.select("batch_id", body.alias("body"))
