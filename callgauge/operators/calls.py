"""Log rows from raw calls, as one projection.

A raw call has: request_id, conversation_id, message_id, provider, model, streaming, messages (array of role and
content), output, err_name, err_code, err_message, http_status, err_body, finish_reason, usage_prompt,
usage_completion, usage_total, usage_estimated, started_at, first_delta_at, ended_at, metadata (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions.text import cut
from callgauge.functions.tokens import BY_LENGTH, Estimator
from callgauge.operators import redaction

# Fixed values.
PREVIEW_LENGTH = 500
MESSAGE_LENGTH = 500
BODY_LENGTH = 300


def call_status() -> Column:
    """An abort cancels a streamed call; a call that was not streamed reports it as an error like any other."""
    aborted = (F.col("err_name") == "AbortError") | (F.col("err_code") == "ABORT_ERR")
    failed = F.col("err_name").isNotNull() | F.col("err_code").isNotNull()
    return (
        F.when(aborted & F.col("streaming"), F.lit("cancelled")).when(failed, F.lit("error")).otherwise(F.lit("success"))
    )


def error_type() -> Column:
    """Class of an error from its HTTP status; ``unknown`` without one."""
    code = F.col("http_status")
    return (
        F.when(code.isNull(), F.lit("unknown"))
        .when(code == 429, F.lit("rate_limit"))
        .when(code >= 500, F.lit("provider_5xx"))
        .otherwise(F.lit("provider_4xx"))
    )


def error_message() -> Column:
    """Who failed, the status and the start of the body; an error without a status brings its own message."""
    source = F.when(F.col("provider") == "anthropic", F.lit("anthropic")).otherwise(F.lit("provider"))
    http = F.concat(
        source, F.lit(" "), F.col("http_status").cast("string"), F.lit(": "), cut(F.coalesce("err_body", F.lit("")), BODY_LENGTH)
    )
    return cut(F.coalesce(http, F.col("err_message")), MESSAGE_LENGTH)


def elapsed_ms(start: str, end: str) -> Column:
    return F.unix_millis(F.col(end).cast("timestamp")) - F.unix_millis(F.col(start).cast("timestamp"))


def ttft_ms() -> Column:
    """Time to the first delta of a streamed call."""
    return F.when(F.col("streaming"), elapsed_ms("started_at", "first_delta_at"))


def input_preview(length: int = PREVIEW_LENGTH) -> Column:
    """Start of the last user message, '' if there is none."""
    from_user = F.filter("messages", lambda m: m["role"] == "user")
    return cut(F.coalesce(F.try_element_at(from_user, F.lit(-1))["content"], F.lit("")), length)


def output_text() -> Column:
    return F.coalesce("output", F.lit(""))


def merge_metadata(metadata: Column, key: Column, value: Column) -> Column:
    """Call metadata overlaid with one key, as JSON text. The key replaces an existing one even when it has no value."""
    base = F.coalesce(
        F.try_variant_get(F.try_parse_json(metadata), "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)")
    )
    rest = F.map_filter(base, lambda k, _: k != key)
    return F.to_json(F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(key, value))))


def derive(
    calls: DataFrame,
    preview_length: int = PREVIEW_LENGTH,
    zero_usage_is_missing: bool = False,
    tokens: Estimator = BY_LENGTH,
) -> DataFrame:
    """Log rows with previews as they were cut, not yet redacted. Calls without an end are left out.

    A streamed call whose provider sent no usage reports 0 tokens, which counts as reported; ``zero_usage_is_missing``
    estimates those instead.
    """
    ended = calls.where(F.col("ended_at").isNotNull()).withColumn("status", call_status())
    success, failed, cancelled = (F.col("status") == s for s in ("success", "error", "cancelled"))

    def usage(name: str) -> Column:
        reported = F.col(name).cast("bigint")
        return F.nullif(reported, F.lit(0).cast("bigint")) if zero_usage_is_missing else reported

    prompt, completion, total = (usage(f"usage_{part}") for part in ("prompt", "completion", "total"))
    prompt_tokens = F.coalesce(prompt, tokens.prompt(F.col("messages")))
    completion_tokens = F.coalesce(completion, tokens.text(output_text()))
    extra_key = F.when(success, F.lit("finishReason")).when(failed, F.lit("status")).otherwise(F.lit("partial"))
    extra = (
        F.when(success, F.col("finish_reason").cast("variant"))
        .when(failed, F.col("http_status").cast("variant"))
        .otherwise(F.lit(True).cast("variant"))
    )
    counted = ended.withColumns(
        {
            "prompt_tokens": F.when(success, prompt_tokens),
            "completion_tokens": F.when(success, completion_tokens).when(cancelled, tokens.text(output_text())),
        }
    )
    return counted.select(
        "request_id",
        "conversation_id",
        "message_id",
        "provider",
        "model",
        "streaming",
        "status",
        F.when(failed, error_type()).alias("error_type"),
        F.when(failed, error_message()).alias("error_message"),
        elapsed_ms("started_at", "ended_at").alias("latency_ms"),
        ttft_ms().alias("ttft_ms"),
        "prompt_tokens",
        "completion_tokens",
        F.when(success, F.coalesce(total, F.col("prompt_tokens") + F.col("completion_tokens"))).alias("total_tokens"),
        F.when(success, F.coalesce("usage_estimated", prompt.isNull() | completion.isNull()))
        .otherwise(cancelled)
        .alias("tokens_estimated"),
        input_preview(preview_length).alias("input_preview"),
        F.when(~failed, cut(output_text(), preview_length)).alias("output_preview"),
        F.col("started_at").alias("requested_at"),
        F.col("ended_at").alias("completed_at"),
        merge_metadata(F.col("metadata"), extra_key, extra).alias("metadata"),
    )


def call_to_log(
    calls: DataFrame,
    preview_length: int = PREVIEW_LENGTH,
    zero_usage_is_missing: bool = False,
    tokens: Estimator = BY_LENGTH,
    redact_columns: tuple[str, ...] = redaction.PREVIEWS,
    redact_first: bool = False,
) -> DataFrame:
    """Stored log rows of raw calls.

    Previews are cut before they are redacted, as the log's producer does it, so personal data cut in half at the edge
    may stay; ``redact_first`` scrubs the whole texts instead.
    """
    if not redact_first:
        return redaction.apply(derive(calls, preview_length, zero_usage_is_missing, tokens), redact_columns)
    whole = derive(calls, 2**31 - 1, zero_usage_is_missing, tokens)
    clean = redaction.apply(whole, redact_columns)
    return clean.withColumns({c: cut(F.col(c), preview_length) for c in redaction.PREVIEWS})


def unfinished(calls: DataFrame) -> DataFrame:
    """Calls that never ended: they have no log row."""
    return calls.where(F.col("ended_at").isNull())


def unreported_usage(logs: DataFrame) -> DataFrame:
    """Per provider: streamed successes that carry 0 tokens without being marked as estimated."""
    silent = (
        F.col("streaming") & (F.col("status") == "success") & ~F.col("tokens_estimated")
        & (F.col("prompt_tokens") == 0) & (F.col("completion_tokens") == 0)
    )
    return logs.groupBy("provider").agg(F.count_if(silent).alias("unreported"), F.count("*").alias("calls"))
