"""Queries over responses and streamed chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.operators import chunks
from callgauge.plans.sql_views import statement
from callgauge.sources import views
from callgauge.sources.tables import table


def usage_openai_json(spark: SparkSession, folder: str) -> DataFrame:
    replies = table(spark, folder, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id", "turn",
        """to_json(named_struct('choices', array(named_struct('message', named_struct('role', role, 'content', text),
           'finish_reason', 'stop')), 'usage', named_struct('prompt_tokens', conv_id, 'completion_tokens', if(turn % 3 = 0, null, turn),
           'total_tokens', conv_id + turn))) as body""",
    )
    return replies.select("conv_id", "turn", chunks.completion_json(F.col("body")).alias("r")).select("conv_id", "turn", "r.*")


def usage_anthropic_json(spark: SparkSession, folder: str) -> DataFrame:
    replies = table(spark, folder, "conversations").where("role = 'assistant'").selectExpr(
        "conv_id", "turn",
        """to_json(named_struct('content', array(named_struct('type', 'text', 'text', text), named_struct('type', 'tool', 'text', null),
           named_struct('type', 'text', 'text', '!')), 'stop_reason', 'end_turn',
           'usage', named_struct('input_tokens', conv_id, 'output_tokens', if(turn % 3 = 0, null, turn)))) as body""",
    )
    return replies.select("conv_id", "turn", chunks.messages_json(F.col("body")).alias("r")).select("conv_id", "turn", "r.*")


def reassemble_openai(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.reassemble(views.completion_lines(spark, folder), "completions")


def reassemble_anthropic(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.reassemble(views.message_lines(spark, folder), "messages")


def sse_data_lines(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.data_lines(views.captured_bodies(spark, folder))


def sse_event_frames(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.frames(views.event_frames(spark, folder)).selectExpr("call_id", "seq", "event", "data")


def split_system(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.system_prompts(views.messages(spark, folder))


QUERIES = {
    "usage_openai_json": usage_openai_json,
    "usage_anthropic_json": usage_anthropic_json,
    "reassemble_openai": reassemble_openai,
    "reassemble_anthropic": reassemble_anthropic,
    "sse_data_lines": sse_data_lines,
    "sse_event_frames": sse_event_frames,
    "split_system": split_system,
}

_ENDS = "(select call_id, max(seq) + 2 as e from chunks group by call_id) n"
_REPLY = "(select conv_id * 100 + turn as call_id, text, len(string_split(text, ' ')) + 1 as e from conversations where role = 'assistant') r"
_JSON = "to_json({'text': delta})"

ORACLE = {
    "usage_openai_json": """select conv_id, turn, text, 'stop' as finish_reason, conv_id as usage_prompt,
        case when turn % 3 <> 0 then turn end as usage_completion, conv_id + turn as usage_total
        from conversations where role = 'assistant'""",
    "usage_anthropic_json": """select conv_id, turn, text || '!' as text, 'end_turn' as finish_reason, conv_id as usage_prompt,
        case when turn % 3 <> 0 then turn end as usage_completion,
        conv_id + case when turn % 3 <> 0 then turn else 0 end as usage_total
        from conversations where role = 'assistant'""",
    "reassemble_openai": f"""select call_id, text, 'stop' as finish_reason, call_id as usage_prompt, e as usage_completion,
        call_id + e as usage_total from {_REPLY}""",
    "reassemble_anthropic": f"""select call_id, text, 'end_turn' as finish_reason, call_id as usage_prompt, e as usage_completion,
        call_id + e as usage_total from {_REPLY}""",
    # line 0 is a comment; every data line is followed by a blank one
    "sse_data_lines": statement(f"""
        select call_id, cast(1 + 2 * n as int) as seq, data from (
         select call_id, 0 as n, '{{"choices":[{{"delta":{{"content":"no"}}}}]}} x' as data from {_ENDS}
         union all select call_id, seq + 1, to_json({{'choices': [{{'delta': {{'content': delta}}}}]}})::varchar from chunks
         union all select call_id, e, '{{"choices":[{{"delta":{{}},"finish_reason":"stop"}}]}}' from {_ENDS}
         union all select call_id, e + 1, '{{"choices":[],"usage":{{"prompt_tokens":' || call_id || ',"completion_tokens":' || e
          || ',"total_tokens":' || (call_id + e) || '}}}}' from {_ENDS}
         union all select call_id, e + 2, '[DONE]' from {_ENDS}
         union all select call_id, e + 3, '{{"choices":[{{"delta":{{"content":"late"}}}}]}}' from {_ENDS}) x"""),
    "sse_event_frames": statement(f"""
        select call_id, cast(seq as int) as seq, event, data from (
        select call_id, 0 as seq, 'meta' as event, '{{"model":"m","provider":"p"}}' as data from {_ENDS}
        union all select call_id, seq + 1, 'delta', {_JSON}::varchar from chunks
        union all select call_id, e + 2, 'message', '{{"text":"plain"}}' from {_ENDS}) x"""),
    "split_system": statement("""
        select conversation_id, nullif(string_agg(content, chr(10) order by turn) filter (where role = 'system'), '') as system
        from messages group by conversation_id"""),
}
