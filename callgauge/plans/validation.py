"""Validation queries. Their input is every log, each with one fault of a list whose verdicts are written down here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.operators import constraints, validate
from callgauge.operators.transcript import state
from callgauge.plans.sql_views import statement
from callgauge.schemas import ENVELOPE, MAX_ISSUES
from callgauge.sources import envelopes, views


def _text(letter: str, n: int) -> str:
    return f'"{letter * n}"'


# Key, JSON value put there (None: key taken out), expected issue codes (blank: accepted).
FAULTS: list[tuple[str, str | None, str]] = [
    ("requestId", None, "invalid_type"),
    ("requestId", '""', "too_small"),
    ("requestId", _text("x", 129), "too_big"),
    ("requestId", "5", "invalid_type"),
    ("requestId", "null", "invalid_type"),
    ("conversationId", '"nope"', "invalid_string"),
    ("conversationId", "null", "invalid_type"),
    ("conversationId", None, ""),
    ("messageId", '"0b0e7a3c-7a52-4d5a-9c1f-0123456789AB"', ""),
    ("messageId", '""', "invalid_string"),
    ("provider", '""', "too_small"),
    ("provider", _text("p", 65), "too_big"),
    ("provider", _text("p", 64), ""),
    ("model", None, "invalid_type"),
    ("model", _text("m", 129), "too_big"),
    ("streaming", '"true"', "invalid_type"),
    ("streaming", None, "invalid_type"),
    ("streaming", "null", "invalid_type"),
    ("status", '"done"', "invalid_enum_value"),
    ("status", "1", "invalid_type"),
    ("errorType", _text("e", 65), "too_big"),
    ("errorType", '""', ""),
    ("errorMessage", _text("m", 2001), "too_big"),
    ("errorMessage", _text("m", 2000), ""),
    ("latencyMs", "-1", "too_small"),
    ("latencyMs", "5.0", ""),
    ("latencyMs", "1e3", ""),
    ("latencyMs", "5.5", "invalid_type"),
    ("latencyMs", '"5"', "invalid_type"),
    ("latencyMs", "3000000000", ""),
    ("latencyMs", "-1.5", "invalid_type,too_small"),
    ("ttftMs", "true", "invalid_type"),
    ("promptTokens", "[1]", "invalid_type"),
    ("completionTokens", '{"x":1}', "invalid_type"),
    ("totalTokens", "null", "invalid_type"),
    ("tokensEstimated", "1", "invalid_type"),
    ("tokensEstimated", "true", ""),
    ("inputPreview", _text("i", 4001), "too_big"),
    ("outputPreview", "7", "invalid_type"),
    ("requestedAt", '"2024-01-01"', "invalid_string"),
    ("requestedAt", '"2024-02-30T00:00:00Z"', "invalid_string"),
    ("requestedAt", '"2024-01-01T00:00:00+01:00"', "invalid_string"),
    ("requestedAt", "1704067200", "invalid_type"),
    ("requestedAt", None, "invalid_type"),
    ("completedAt", "null", "invalid_type"),
    ("completedAt", '"2024-01-01T10:30Z"', ""),
    ("metadata", "[]", "invalid_type"),
    ("metadata", '"x"', "invalid_type"),
    ("metadata", "null", "invalid_type"),
    ("metadata", "{}", ""),
    ("surprise", "1", ""),
]
BIG = [i for i, (_, value, _) in enumerate(FAULTS) if value == "3000000000"]


def _faulty(spark: SparkSession, folder: str) -> DataFrame:
    return views.faulty_envelopes(spark, folder, FAULTS)


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    return validate.check(envelopes.parse(_faulty(spark, folder)))


def _verdicts(*kinds: str, required: bool | None = None):
    """Issues of the keys of some kinds."""
    paths = [f.name for f in ENVELOPE if f.kind in kinds and required in (None, f.required)]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return (
            _checked(spark, folder)
            .select("event_id", F.inline("issues"))
            .where(F.col("path").isin(*paths))
        )

    sql = f"""select event_id, path, unnest(string_split(codes, ',')) as code from events
        join faults on n = event_id % {len(FAULTS)} where codes <> '' and path in ({', '.join(repr(p) for p in paths)})"""
    return run, statement(sql, faults=SQL_FAULTS)


def strip_unknown(spark: SparkSession, folder: str) -> DataFrame:
    read = envelopes.parse(_faulty(spark, folder))
    keys = F.json_object_keys(validate.strip_unknown(F.col("log")))
    return read.select("event_id", F.array_join(F.array_sort(keys), ",").alias("keys"))


def issues(spark: SparkSession, folder: str) -> DataFrame:
    """What the sender of each batch of 50 is told: its first 20 issues."""
    read = envelopes.parse(views.batches(_faulty(spark, folder), 50), "body", "batch")
    told = validate.first_issues(F.col("issues"))
    listed = F.array_join(F.transform(told, lambda i: F.concat_ws(":", i["path"], i["code"])), " ")
    return validate.check_batches(read).select("batch_id", F.size("issues").alias("n_issues"), listed.alias("told"))


def batch_envelope(spark: SparkSession, folder: str) -> DataFrame:
    read = envelopes.parse(views.batches(views.envelopes(spark, folder), 50), "body", "batch")
    return envelopes.explode_batches(read).select(
        "batch_id", "position", F.try_variant_get("log", "$.requestId", "string").alias("request_id")
    )


def batch_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of 501 logs, of 500 and of none; the last ones may be shorter."""
    sized = views.batches(views.envelopes(spark, folder), by="event_id div 1001 * 3 + if(event_id % 1001 < 501, 0, 1)")
    empty = sized.where("batch_id % 3 = 0").select((F.col("batch_id") + 2).alias("batch_id"), F.lit('{"logs":[]}').alias("body"))
    read = envelopes.parse(sized.select("batch_id", "body").unionByName(empty), "body", "batch")
    return validate.check_batches(read).select(
        "batch_id", F.size(F.try_variant_get("batch", "$.logs", "array<variant>")).alias("n"),
        F.coalesce(F.try_element_at("issues", F.lit(1))["code"], F.lit("ok")).alias("verdict"),
    )


def batch_all_or_nothing(spark: SparkSession, folder: str) -> DataFrame:
    """Logs taken from batches of 3 when one bad log refuses its batch, next to those taken one by one."""
    read = envelopes.parse(views.batches(_faulty(spark, folder), 3), "body", "batch")
    checked = validate.check_batches(read)
    n = F.coalesce(F.size(F.try_variant_get("batch", "$.logs", "array<variant>")), F.lit(0)).cast("bigint")
    # an issue of a log is named logs.N, so the batch's issues tell which logs are good
    bad = F.array_distinct(F.transform("issues", lambda i: F.regexp_extract(i["path"], r"^logs\.(\d+)", 1)))
    return checked.select(
        "batch_id",
        F.when(F.size("issues") == 0, n).otherwise(F.lit(0).cast("bigint")).alias("taken_by_batch"),
        (n - F.size(F.array_remove(bad, ""))).alias("taken_by_row"),
    )


def payload_field(spark: SparkSession, folder: str) -> DataFrame:
    """Bus entries as flat lists: a decoy value, a missing payload and an empty one among them."""
    entries = views.envelopes(spark, folder).selectExpr(
        "event_id",
        """case event_id % 4 when 0 then array('payload', payload) when 1 then array('note', 'payload', 'payload', payload)
           when 2 then array('note', 'payload') else array('payload', '') end as fields""",
    )
    kept = envelopes.entries_with_payload(entries)
    read = envelopes.parse(kept.select("event_id", "payload"))
    return read.select("event_id", F.try_variant_get("log", "$.requestId", "string").alias("request_id"))


def parse_drop_corrupt(spark: SparkSession, folder: str) -> DataFrame:
    """Text cut short and a JSON null never become rows."""
    texts = views.envelopes(spark, folder).selectExpr(
        "event_id", "case event_id % 13 when 5 then substring(payload, 1, 40) when 6 then 'null' else payload end as payload"
    )
    is_object = F.coalesce(F.schema_of_variant("log").startswith("OBJECT"), F.lit(False))
    return envelopes.parse(texts).select("event_id", is_object.alias("kept"))


def _plain_times(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("requested_at", "completed_at")})


def publish_events(spark: SparkSession, folder: str) -> DataFrame:
    """Rows to bus records and back."""
    events = envelopes.to_events(views.sent_logs(spark, folder))
    return _plain_times(validate.typed_rows(envelopes.parse(events, "value")))


def columns_default(spark: SparkSession, folder: str) -> DataFrame:
    """Stored columns of envelopes without flag and, every fourth, without metadata."""
    sent = views.sent_logs(spark, folder).withColumn("metadata", F.expr("if(event_id % 4 = 0, null, metadata)"))
    read = envelopes.parse(sent.select(envelopes.to_payload(sent).alias("payload")))
    return _plain_times(validate.typed_rows(read)).select(
        "request_id", "conversation_id", "message_id", "error_message", "prompt_tokens", "tokens_estimated", "metadata", "completed_at"
    )


def int_range_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Logs the edge accepts and an INT column refuses."""
    checked = validate.check(envelopes.parse(_faulty(spark, folder)), with_columns=True)
    return checked.where((F.size("issues") == 0) & validate.out_of_range()).select("event_id", "latency_ms")


def constraint_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of the three tables on rows that were never validated, against conversations without the cancelled ones."""
    typed = validate.typed_rows(envelopes.parse(_faulty(spark, folder)))
    unchecked = typed.withColumns(
        {"pii_redacted": F.expr("if(status is null, null, false)"), "ingested_at": F.expr("if(provider is null, null, requested_at)")}
    )
    open_only = state(views.conversation_events(spark, folder)).where("status = 'active'")
    return constraints.report(unchecked, views.messages(spark, folder), open_only)


SQL_FAULTS = "select * from (values " + ", ".join(
    f"({i}, '{key}', {'true' if value is None else 'false'}, '{codes}')" for i, (key, value, codes) in enumerate(FAULTS)
) + ") f(n, path, gone, codes)"
_BY_KIND = {
    "validate_required_str": _verdicts("str", required=True),
    "validate_optional_str": _verdicts("str", required=False),
    "validate_uuid": _verdicts("uuid"),
    "validate_bool": _verdicts("bool"),
    "validate_enum": _verdicts("status"),
    "validate_nonneg_int": _verdicts("int"),
    "validate_datetime": _verdicts("time"),
    "validate_metadata": _verdicts("object"),
}

QUERIES = {
    **{name: run for name, (run, _) in _BY_KIND.items()},
    "strip_unknown": strip_unknown,
    "issues": issues,
    "batch_envelope": batch_envelope,
    "batch_bounds": batch_bounds,
    "batch_all_or_nothing": batch_all_or_nothing,
    "payload_field": payload_field,
    "parse_drop_corrupt": parse_drop_corrupt,
    "publish_events": publish_events,
    "columns_default": columns_default,
    "int_range_quarantine": int_range_quarantine,
    "constraint_report": constraint_report,
}

_N = len(FAULTS)
_ORDER = "case path " + " ".join(f"when '{f.name}' then {i}" for i, f in enumerate(ENVELOPE)) + " else 99 end"
_UUID = "'00000000-0000-4000-8000-' || lpad(lower(to_hex(conversation_id)), 12, '0')"
# Keys every envelope has, and the optional ones with the condition they are there under.
_ALWAYS = ("requestId", "conversationId", "provider", "model", "streaming", "status", "latencyMs", "inputPreview", "requestedAt", "metadata")
_SOMETIMES = {
    "errorType": "error_type is not null",
    "ttftMs": "ttft_ms is not null",
    "totalTokens": "total_tokens is not null",
    "outputPreview": "output_preview is not null",
    "completedAt": "event_id % 3 <> 0",
}
_PRESENT = " union all ".join(
    [f"select event_id, '{k}' as key from logs" for k in _ALWAYS]
    + [f"select event_id, '{k}' from logs where {cond}" for k, cond in _SOMETIMES.items()]
)
_COMPLETED = "case when event_id % 3 <> 0 then requested_at + latency_ms * interval '1' millisecond end"


def _rule(table: str, rule: str, count: str) -> str:
    return f"select '{table}' as \"table\", '{rule}' as rule, ({count}) as violations"


def _nulls(key: str, *wrong: int) -> str:
    """Rows whose key is gone or does not read as its type."""
    listed = [i for i, (k, v, codes) in enumerate(FAULTS) if k == key and (v in (None, "null") or i in wrong)]
    return f"select count(*) from events where event_id % {_N} in ({', '.join(map(str, listed)) or -1})"


def _nulls_of_either() -> str:
    """Rows without a provider, and those without a time: one fault per row, so nothing counts twice."""
    return f"({_nulls('provider')}) + ({_nulls('requestedAt', *_UNREADABLE_TIME)})"


_UNREADABLE_TIME = [i for i, (k, v, _) in enumerate(FAULTS) if k == "requestedAt" and v in ('"2024-02-30T00:00:00Z"', '1704067200')]
_ODD_STATUS = [i for i, (k, v, _) in enumerate(FAULTS) if k == "status"]
_LIVE = "(select conv_id from state where status = 'active')"
_LOST_ID = [i for i, (k, v, _) in enumerate(FAULTS) if k == "requestId"]

ORACLE = {
    **{name: sql for name, (_, sql) in _BY_KIND.items()},
    "strip_unknown": statement(
        f"""select event_id, string_agg(key, ',' order by key) as keys from (
          select event_id, key from ({_PRESENT}) p
          where not exists (select 1 from faults f where f.n = p.event_id % {_N} and f.path = p.key)
          union all select event_id, path from events join faults on n = event_id % {_N} where not gone and path <> 'surprise') k
        group by event_id""",
        faults=SQL_FAULTS,
    ),
    "issues": statement(
        f"""select b.batch_id, cast(coalesce(n_issues, 0) as int) as n_issues, coalesce(told, '') as told
        from (select distinct event_id // 50 as batch_id from events) b left join (
         select batch_id, max(n_all) as n_issues, string_agg(line, ' ' order by r) as told from (
          select batch_id, line, row_number() over w as r, count(*) over (partition by batch_id) as n_all from (
           select event_id, event_id // 50 as batch_id, pos, 'logs.' || (event_id % 50) || '.' || path || ':' || code as line from (
            select event_id, path, unnest(string_split(codes, ',')) as code, unnest(range(len(string_split(codes, ',')))) as pos
            from events join faults on n = event_id % {_N} where codes <> '') u) l
          window w as (partition by batch_id order by event_id, pos)) k
         where r <= {MAX_ISSUES} group by batch_id) i on i.batch_id = b.batch_id""",
        faults=SQL_FAULTS,
    ),
    "batch_envelope": statement("select event_id // 50 as batch_id, cast(event_id % 50 as int) as position, request_id from logs"),
    "batch_bounds": """select batch_id, cast(n as int) as n, case when n < 1 then 'too_small' when n > 500 then 'too_big' else 'ok' end as verdict
        from (select event_id // 1001 * 3 + case when event_id % 1001 < 501 then 0 else 1 end as batch_id, count(*) as n from events group by 1
              union all select distinct event_id // 1001 * 3 + 2, 0 from events where event_id % 1001 < 501) b""",
    "batch_all_or_nothing": statement(
        f"""select event_id // 3 as batch_id, case when bool_and(codes = '') then count(*) else 0 end as taken_by_batch,
        count(*) filter (where codes = '') as taken_by_row from events join faults on n = event_id % {_N} group by 1""",
        faults=SQL_FAULTS,
    ),
    "payload_field": statement("select event_id, request_id from logs where event_id % 4 in (0, 1)"),
    "parse_drop_corrupt": "select event_id, event_id % 13 not in (5, 6) as kept from events",
    "publish_events": statement(f"""
        select request_id as key, request_id, {_UUID} as conversation_id, cast(null as varchar) as message_id, provider, model,
         streaming, status, error_type, cast(null as varchar) as error_message,
         cast(latency_ms as bigint) as latency_ms, cast(ttft_ms as bigint) as ttft_ms, cast(null as bigint) as prompt_tokens,
         cast(null as bigint) as completion_tokens, cast(total_tokens as bigint) as total_tokens, false as tokens_estimated,
         input_preview || case event_id % 5 when 0 then ' from me@x.io' when 1 then ' at 8.8.8.8' else '' end as input_preview,
         output_preview, requested_at, {_COMPLETED} as completed_at, replace(metadata, ' ', '') as metadata from logs"""),
    "columns_default": statement(f"""
        select request_id, {_UUID} as conversation_id, cast(null as varchar) as message_id, cast(null as varchar) as error_message,
         cast(null as bigint) as prompt_tokens, false as tokens_estimated,
         case when event_id % 4 = 0 then '{{}}' else replace(metadata, ' ', '') end as metadata, {_COMPLETED} as completed_at from logs"""),
    "int_range_quarantine": f"select event_id, 3000000000 as latency_ms from events where event_id % {_N} = {BIG[0]}",
    "constraint_report": statement(
        " union all ".join(
            [
                _rule("logs", "request_id not null", _nulls("requestId")),
                _rule("logs", "provider not null", _nulls("provider")),
                _rule("logs", "model not null", _nulls("model")),
                _rule("logs", "streaming not null", "0"),
                _rule("logs", "status not null", _nulls("status")),
                _rule("logs", "tokens_estimated not null", "0"),
                _rule("logs", "requested_at not null", _nulls("requestedAt", *_UNREADABLE_TIME)),
                _rule("logs", "metadata not null", "0"),
                _rule("logs", "pii_redacted not null", _nulls("status")),
                _rule("logs", "ingested_at not null", _nulls_of_either()),
                _rule("logs", "status check", f"select count(*) from events where event_id % {_N} in ({', '.join(map(str, _ODD_STATUS))})"),
                _rule("logs", "request_id unique", f"""select coalesce(sum(extra), 0)::bigint from (select count(*) - 1 as extra from
                    (select case event_id % {_N} when 0 then null when 1 then '' when 2 then repeat('x', 129) when 3 then '5' when 4 then null
                     else request_id end as id from logs) i where id is not null group by id) u"""),
                _rule("messages", "conversation_id references", f"select count(*) from messages where conversation_id not in {_LIVE}"),
                _rule("messages", "conversation_id not null", "0"),
                _rule("messages", "role not null", "0"),
                _rule("messages", "content not null", "0"),
                _rule("messages", "created_at not null", "0"),
                _rule("messages", "role check", "0"),
                _rule("messages", "conversation_id, turn unique", "0"),
                _rule("conversations", "status not null", "0"),
                _rule("conversations", "created_at not null", "0"),
                _rule("conversations", "updated_at not null", "0"),
                _rule("conversations", "status check", "0"),
                _rule("conversations", "conv_id unique", "0"),
            ]
        )
    ),
}
