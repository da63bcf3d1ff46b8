"""Transcript queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.functions.tokens import estimate_prompt
from callgauge.operators import transcript
from callgauge.operators.calls import call_to_log
from callgauge.plans.sql_views import statement
from callgauge.session import scratch_dir
from callgauge.sources import bucketed
from callgauge.sources.tables import table
from callgauge.sources.views import conversation_events, logs, messages, raw_calls


def _state(spark: SparkSession, folder: str) -> DataFrame:
    return transcript.state(conversation_events(spark, folder))


def list_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return transcript.list_conversations(_state(spark, folder), messages(spark, folder))


def get_conversation(spark: SparkSession, folder: str) -> DataFrame:
    return transcript.get(_state(spark, folder), messages(spark, folder), 8)


def scan_transcript(spark: SparkSession, folder: str) -> DataFrame:
    return messages(spark, folder).select("conversation_id", "turn", "role", "created_at")


def resume_view(spark: SparkSession, folder: str) -> DataFrame:
    return transcript.resume_view(messages(spark, folder))


def context_window(spark: SparkSession, folder: str) -> DataFrame:
    said = F.array_join(F.transform("context", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return transcript.context_window(messages(spark, folder)).select(
        "conversation_id",
        "turn",
        F.size("context").alias("n_messages"),
        estimate_prompt(F.col("context")).alias("prompt_tokens"),
        F.md5(said).alias("context_md5"),
    )


def title(spark: SparkSession, folder: str) -> DataFrame:
    return transcript.titles(messages(spark, folder))


def conversation_state(spark: SparkSession, folder: str) -> DataFrame:
    return _state(spark, folder)


def accept_turn(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "conversations").where("role = 'user'").selectExpr(
        "case when (conv_id + turn) % 13 = 0 then conv_id + 1000000 else conv_id end as conv_id",
        "turn",
        "case when (conv_id + turn) % 11 = 0 then concat(' ', chr(10), chr(9)) else text end as message",
    )
    return transcript.accept_turns(asked, _state(spark, folder)).select("conv_id", "turn", "outcome")


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    purged = _state(spark, folder).where("status = 'cancelled'")
    return transcript.cascade_delete(messages(spark, folder), purged).select("conversation_id", "turn", "role")


def logs_with_conversation(spark: SparkSession, folder: str) -> DataFrame:
    return transcript.logs_with_conversation(logs(spark, folder), _state(spark, folder)).select(
        "request_id", "conversation_id", "title", "conversation_status"
    )


def orphan_logs(spark: SparkSession, folder: str) -> DataFrame:
    return transcript.orphan_logs(logs(spark, folder), _state(spark, folder)).select("request_id", "conversation_id")


def partial_turns(spark: SparkSession, folder: str) -> DataFrame:
    stored = call_to_log(raw_calls(spark, folder))
    return transcript.partial_turns(stored, messages(spark, folder)).select("request_id", "conversation_id", "saved_at")


def conversation_usage(spark: SparkSession, folder: str) -> DataFrame:
    return transcript.conversation_usage(logs(spark, folder), _state(spark, folder))


def _stored(spark: SparkSession, folder: str) -> bucketed.Store:
    """Logs and conversations by conversation, the busier conversations apart from the others."""
    name = f"by_conversation_{uuid.uuid4().hex}"
    rows, known = logs(spark, folder), _state(spark, folder)
    busy = rows.groupBy("conversation_id").count().agg(F.percentile("count", 0.9)).first()[0] or 0
    return bucketed.write(rows, known, name, scratch_dir(spark, name), 8, wide_rows=int(busy))


def bucketed_logs(spark: SparkSession, folder: str) -> DataFrame:
    found = bucketed.of_conversation(spark, _stored(spark, folder), 7)
    return found.select("request_id", "conversation_id", "requested_at")


def bucketed_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = bucketed.with_conversation(spark, _stored(spark, folder))
    return joined.select("request_id", "conversation_id", "title", "conversation_status")


def bucketed_usage(spark: SparkSession, folder: str) -> DataFrame:
    return bucketed.usage(spark, _stored(spark, folder))


QUERIES = {
    "list_conversations": list_conversations,
    "get_conversation": get_conversation,
    "scan_transcript": scan_transcript,
    "resume_view": resume_view,
    "context_window": context_window,
    "title": title,
    "conversation_state": conversation_state,
    "accept_turn": accept_turn,
    "cascade_delete": cascade_delete,
    "logs_with_conversation": logs_with_conversation,
    "orphan_logs": orphan_logs,
    "partial_turns": partial_turns,
    "conversation_usage": conversation_usage,
    "bucketed_logs": bucketed_logs,
    "bucketed_join": bucketed_join,
    "bucketed_usage": bucketed_usage,
}

ORACLE = {
    "list_conversations": statement("""
        select c.*, coalesce(n, 0) as msg_count from state c left join (
         select conversation_id, count(*) as n from messages where role <> 'system' group by conversation_id
        ) m on m.conversation_id = c.conv_id order by updated_at desc, conv_id limit 200"""),
    "get_conversation": statement("""
        select c.*, m.turn, m.role, m.content, m.created_at as said_at from state c
        left join messages m on m.conversation_id = c.conv_id where c.conv_id = 8"""),
    "scan_transcript": statement("select conversation_id, turn, role, created_at from messages"),
    "resume_view": statement("select conversation_id, turn, role, content from messages where role <> 'system'"),
    "context_window": statement("""
        select conversation_id, turn, cast(n_messages as int) as n_messages, prompt_tokens, md5(array_to_string(said, chr(10))) as context_md5 from (
         select conversation_id, turn, role, count(*) over w as n_messages,
          cast(sum(ceil(length(content) / 4.0) + 4) over w as bigint) as prompt_tokens, list(role || ':' || content) over w as said
         from messages where role <> 'system'
         window w as (partition by conversation_id order by turn rows between 19 preceding and current row)) x
        where role = 'user'"""),
    "title": statement("""select conversation_id, substring(min_by(content, turn), 1, 60) as title
        from messages where role = 'user' group by conversation_id"""),
    "conversation_state": statement("select * from state"),
    "accept_turn": statement("""
        select t.conv_id, t.turn, case when blank then 'bad_request' when s.status is null then 'not_found'
         when s.status = 'cancelled' then 'conversation_cancelled' else 'accepted' end as outcome
        from (select case when (conv_id + turn) % 13 = 0 then conv_id + 1000000 else conv_id end as conv_id, turn,
               (conv_id + turn) % 11 = 0 or trim(text) = '' as blank from conversations where role = 'user') t
        left join state s on s.conv_id = t.conv_id"""),
    "cascade_delete": statement("""select conversation_id, turn, role from messages
        where conversation_id not in (select conv_id from state where status = 'cancelled')"""),
    "logs_with_conversation": statement("""select request_id, conversation_id, title, status as conversation_status
        from (select request_id, conversation_id from logs) l left join (select conv_id, title, status from state) s
        on s.conv_id = l.conversation_id"""),
    "orphan_logs": statement("""select request_id, conversation_id from logs
        where conversation_id not in (select conv_id from state)"""),
    "partial_turns": statement("""
        select c.request_id, c.conv_id as conversation_id, max(m.created_at) as saved_at from calls c
        join messages m on m.conversation_id = c.conv_id and m.role = 'assistant'
         and substring(m.content, 1, 500) = substring(c.output, 1, 500)
        where c.err_name = 'AbortError' and c.call_id % 3 <> 0 and c.output <> '' group by all
        having max(m.created_at) >= max(c.started_at)"""),
    "conversation_usage": statement("""
        select u.*, s.title, s.status as conversation_status from (
         select conversation_id, count(*) as calls, count(*) filter (where status = 'error') as errors,
          cast(coalesce(sum(total_tokens), 0) as bigint) as tokens, cast(sum(latency_ms) as bigint) as latency_ms,
          max(latency_ms) as max_latency_ms, max(requested_at) as last_request from logs group by conversation_id) u
        left join state s on s.conv_id = u.conversation_id"""),
}
ORACLE["bucketed_logs"] = statement("select request_id, conversation_id, requested_at from logs where conversation_id = 7")
ORACLE["bucketed_join"] = ORACLE["logs_with_conversation"]
ORACLE["bucketed_usage"] = ORACLE["conversation_usage"]
