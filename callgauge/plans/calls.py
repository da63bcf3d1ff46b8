"""Queries deriving log rows from raw calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.functions.tokens import estimate_prompt, estimate_tokens
from callgauge.operators import calls
from callgauge.operators.chunks import first_delta_at
from callgauge.plans.redaction import sql_all
from callgauge.plans.sql_views import statement
from callgauge.sources.tables import table
from callgauge.sources.views import raw_calls, timed_chunks


def _derived(*columns: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return calls.derive(raw_calls(spark, folder)).select("request_id", *columns)

    return run


def _rows(status: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return calls.derive(raw_calls(spark, folder)).where(F.col("status") == status)

    return run


def call_status(spark: SparkSession, folder: str) -> DataFrame:
    return raw_calls(spark, folder).select("request_id", calls.call_status().alias("status"))


def ttft_ms(spark: SparkSession, folder: str) -> DataFrame:
    """From the chunks themselves; a reply's chunks are numbered one above its call."""
    first = first_delta_at(timed_chunks(spark, folder)).withColumn("call_id", F.col("call_id") - 1)
    timed = raw_calls(spark, folder).drop("first_delta_at").join(first, "call_id", "left")
    return timed.select("request_id", calls.ttft_ms().alias("ttft_ms"))


def estimate_tokens_query(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


def estimate_prompt_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return raw_calls(spark, folder).select("request_id", estimate_prompt(F.col("messages")).alias("prompt_tokens"))


def dead_usage_check(spark: SparkSession, folder: str) -> DataFrame:
    return calls.unreported_usage(calls.derive(raw_calls(spark, folder)))


def call_to_log(spark: SparkSession, folder: str) -> DataFrame:
    return calls.call_to_log(raw_calls(spark, folder))


QUERIES = {
    "call_status": call_status,
    "error_type": _derived("error_type"),
    "error_message": _derived("error_message"),
    "latency_ms": _derived("latency_ms"),
    "ttft_ms": ttft_ms,
    "input_preview": _derived("input_preview"),
    "output_preview": _derived("output_preview"),
    "estimate_tokens": estimate_tokens_query,
    "estimate_prompt_tokens": estimate_prompt_tokens,
    "usage_fallback": _derived("prompt_tokens", "completion_tokens"),
    "total_tokens": _derived("total_tokens"),
    "tokens_estimated": _derived("tokens_estimated"),
    "row_success": _rows("success"),
    "row_error": _rows("error"),
    "row_cancelled": _rows("cancelled"),
    "metadata_merge": _derived("metadata"),
    "dead_usage_check": dead_usage_check,
    "call_to_log": call_to_log,
}

TOKENS = "cast(ceil(length({0}) / 4.0) as bigint)"

# The derivation written per status, as the producer does it, rather than per column.
COMMON = """request_id, conv_id as conversation_id, cast(null as varchar) as message_id,
 case conv_id % 4 when 0 then 'anthropic' when 1 then 'openai' when 2 then 'gemini' else 'mock' end as provider,
 case when turn % 4 < 2 then 'large' else 'small' end as model, call_id % 3 <> 0 as streaming"""
TIMES = """1000 + 1000 * (call_id % 7) as latency_ms,
 case when call_id % 3 <> 0 and output is not null then 72 + 40 * (call_id % 5) end as ttft_ms"""
ENDS = "started_at as requested_at, ended_at as completed_at"
INPUT = "substring(last_user, 1, 500) as input_preview"
PROMPT = f"{TOKENS.format('last_user')} + 4 + {TOKENS.format(repr('answer briefly'))} + 4"
REPLY = "coalesce(output, '')"
SURFACE = '{"surface":"chat"'
MINE = '{"finishReason":"mine","surface":"chat"'

DERIVED = f"""
select {COMMON}, 'success' as status, cast(null as varchar) as error_type, cast(null as varchar) as error_message, {TIMES},
 p as prompt_tokens, c as completion_tokens, coalesce(usage_total, p + c) as total_tokens,
 case when call_id % 20 = 15 then true when call_id % 20 = 7 then false
  else usage_prompt is null or usage_completion is null end as tokens_estimated,
 {INPUT}, substring({REPLY}, 1, 500) as output_preview, {ENDS},
 case call_id % 3 when 0 then '{SURFACE},"finishReason":"stop"}}' when 1 then '{SURFACE},"finishReason":"length"}}'
  else '{SURFACE}}}' end as metadata
from (select *, case when call_id % 20 = 7 then 0 else coalesce(usage_prompt, {PROMPT}) end as p,
  case when call_id % 20 = 7 then 0 else coalesce(usage_completion, {TOKENS.format(REPLY)}) end as c from calls) x
where err_name is null
union all
select {COMMON}, 'error', case http_status when 429 then 'rate_limit' when 503 then 'provider_5xx' when 400 then 'provider_4xx' else 'unknown' end,
 case when err_name = 'AbortError' then 'aborted' when http_status is null then substring('lost connection: ' || last_user, 1, 500)
  else case conv_id % 4 when 0 then 'anthropic ' else 'provider ' end || http_status || ': ' || substring(last_user, 1, 300) end, {TIMES},
 null, null, null, false, {INPUT}, null, {ENDS},
 case when call_id % 6 = 0 then '{MINE}' else '{SURFACE}' end
  || case when http_status is null then '}}' else ',"status":' || http_status || '}}' end
from calls where err_name = 'Error' or err_name = 'AbortError' and call_id % 3 = 0
union all
select {COMMON}, 'cancelled', null, null, {TIMES}, null, {TOKENS.format(REPLY)}, null, true, {INPUT}, substring({REPLY}, 1, 500), {ENDS},
 case when call_id % 6 = 0 then '{MINE},"partial":true}}' else '{SURFACE},"partial":true}}' end
from calls where err_name = 'AbortError' and call_id % 3 <> 0"""


def _select(columns: str, where: str = "") -> str:
    return statement(f"select {columns} from derived {where}", derived=DERIVED)


def _stored() -> str:
    clean = f"select *, {sql_all('input_preview')} as ci, {sql_all('output_preview')} as co from derived"
    return statement(
        "select * exclude (input_preview, output_preview, ci, co), ci as input_preview, co as output_preview, "
        f"coalesce(ci <> input_preview, false) or coalesce(co <> output_preview, false) as pii_redacted from ({clean}) d",
        derived=DERIVED,
    )


ORACLE = {
    "call_status": _select("request_id, status"),
    "error_type": _select("request_id, error_type"),
    "error_message": _select("request_id, error_message"),
    "latency_ms": _select("request_id, latency_ms"),
    "ttft_ms": statement("""
        select request_id, case when call_id % 3 <> 0 then epoch_ms(first_at) - epoch_ms(started_at) end as ttft_ms
        from calls left join (select call_id - 1 as cid,
         min(timestamp '2024-01-01 00:00:00' + (call_id - 1) * interval '1' second + (72 + 18 * seq) * interval '1' millisecond) as first_at
         from chunks where delta <> '' group by 1) f on f.cid = call_id"""),
    "input_preview": _select("request_id, input_preview"),
    "output_preview": _select("request_id, output_preview"),
    "estimate_tokens": f"select doc_id, {TOKENS.format('text')} as tokens from documents",
    "estimate_prompt_tokens": statement(f"select request_id, {PROMPT} as prompt_tokens from calls"),
    "usage_fallback": _select("request_id, prompt_tokens, completion_tokens"),
    "total_tokens": _select("request_id, total_tokens"),
    "tokens_estimated": _select("request_id, tokens_estimated"),
    "row_success": _select("*", "where status = 'success'"),
    "row_error": _select("*", "where status = 'error'"),
    "row_cancelled": _select("*", "where status = 'cancelled'"),
    "metadata_merge": _select("request_id, metadata"),
    "dead_usage_check": _select(
        """provider, count(*) filter (where streaming and status = 'success' and not tokens_estimated
         and prompt_tokens = 0 and completion_tokens = 0) as unreported, count(*) as calls""",
        "group by provider",
    ),
    "call_to_log": _stored(),
}
