"""Provider responses and streamed chunks.

Chunks of one call are put together in two steps, first within blocks of consecutive numbers and then over the blocks,
so a call with very many chunks is spread over tasks until only its text is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions.json import strict
from callgauge.functions.text import strip

#: Consecutive chunks put together in one group of the first step.
BLOCK = 1024

DONE = "[DONE]"


def _get(v: Column, path: str, as_type: str = "string") -> Column:
    return F.try_variant_get(v, path, as_type)


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def completion_json(body: Column) -> Column:
    """Text, finish reason and usage of a chat-completions response."""
    v = strict(body)
    return F.struct(
        F.coalesce(_get(v, "$.choices[0].message.content"), F.lit("")).alias("text"),
        _get(v, "$.choices[0].finish_reason").alias("finish_reason"),
        *[_get(v, f"$.usage.{part}_tokens", "bigint").alias(f"usage_{part}") for part in ("prompt", "completion", "total")],
    )


def messages_json(body: Column) -> Column:
    """The same for a response made of content blocks; its total counts a missing part as 0."""
    v = strict(body)
    blocks = _get(v, "$.content", "array<variant>")
    prompt, completion = (_get(v, f"$.usage.{side}_tokens", "bigint") for side in ("input", "output"))
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.coalesce(F.array_join(F.transform(blocks, lambda b: _get(b, "$.text")), ""), F.lit("")).alias("text"),
        _get(v, "$.stop_reason").alias("finish_reason"),
        prompt.alias("usage_prompt"),
        completion.alias("usage_completion"),
        (F.coalesce(prompt, zero) + F.coalesce(completion, zero)).alias("usage_total"),
    )


def _completion_chunk(v: Column) -> dict[str, Column]:
    return {
        "text": _filled(_get(v, "$.choices[0].delta.content")),
        "finish_reason": _filled(_get(v, "$.choices[0].finish_reason")),
        **{f"usage_{p}": _get(v, f"$.usage.{p}_tokens", "bigint") for p in ("prompt", "completion", "total")},
    }


def _messages_chunk(v: Column) -> dict[str, Column]:
    kind = _get(v, "$.type")
    started, said, changed = (kind == k for k in ("message_start", "content_block_delta", "message_delta"))
    return {
        "text": F.when(said, _filled(_get(v, "$.delta.text"))),
        "finish_reason": F.when(changed, _filled(_get(v, "$.delta.stop_reason"))),
        "usage_prompt": F.when(started, F.coalesce(_get(v, "$.message.usage.input_tokens", "bigint"), F.lit(0).cast("bigint"))),
        "usage_completion": F.when(changed, _get(v, "$.usage.output_tokens", "bigint")),
        "usage_total": F.lit(None).cast("bigint"),
    }


DIALECTS = {"completions": _completion_chunk, "messages": _messages_chunk}
LAST = ("finish_reason", "usage_prompt", "usage_completion", "usage_total")


def reassemble(lines: DataFrame, dialect: str) -> DataFrame:
    """Per call the whole text, last finish reason and last usage of its ``data`` lines, ordered by ``seq``.

    Lines that are no JSON are skipped. In the completions dialect everything after the end marker is ignored.
    """
    v = F.col("_v")
    parsed = lines.select("call_id", "seq", "data", strict(F.col("data")).alias("_v"))
    ends = (F.col("data") == DONE) if dialect == "completions" else F.lit(False)
    events = (
        parsed.select("call_id", "seq", ends.alias("stop"), *[c.alias(n) for n, c in DIALECTS[dialect](v).items()])
        .withColumn("_block", F.floor(F.col("seq") / BLOCK))
    )
    within = _fold(events, ["call_id", "_block"], "seq", keep_stop=False)
    whole = _fold(within, ["call_id"], "_block", keep_stop=True)
    zero = F.lit(0).cast("bigint")
    prompt, completion, total = (F.coalesce(f"usage_{p}", zero) for p in ("prompt", "completion", "total"))
    return whole.select(
        "call_id",
        "text",
        "finish_reason",
        prompt.alias("usage_prompt"),
        completion.alias("usage_completion"),
        (prompt + completion if dialect == "messages" else total).alias("usage_total"),
    )


def _fold(rows: DataFrame, keys: list[str], order: str, keep_stop: bool) -> DataFrame:
    """Joins texts and takes last values in ``order`` up to the first row marked ``stop`` (with it if ``keep_stop``)."""
    entry = F.struct(order, "stop", "text", *LAST)
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    at = F.array_position(F.transform("_rows", lambda r: r["stop"]), F.lit(True)).cast("int")
    kept = F.when(at > 0, F.slice("_rows", F.lit(1), at if keep_stop else at - 1)).otherwise(F.col("_rows"))
    cut = listed.select(*keys, (at > 0).alias("stop"), kept.alias("_rows"))

    def last(name: str) -> Column:
        known = F.filter(F.transform("_rows", lambda r: r[name]), lambda x: x.isNotNull())
        return F.try_element_at(known, F.lit(-1)).alias(name)

    text = F.array_join(F.transform("_rows", lambda r: r["text"]), "").alias("text")
    return cut.select(*keys, "stop", text, *[last(name) for name in LAST])


def first_delta_at(timed: DataFrame) -> DataFrame:
    """Arrival of the first non-empty delta per call."""
    return timed.where(F.col("delta") != "").groupBy("call_id").agg(F.min("arrived_at").alias("first_delta_at"))


def join_text(rows: DataFrame, key: str, order: str, text: str, separator: str, alias: str) -> DataFrame:
    """``text`` of each key joined in ``order``, nulls skipped; null where there is none. Two steps, as above."""
    by_block = rows.select(key, order, text).withColumn("_block", F.floor(F.col(order) / BLOCK))
    part = f"listagg({text}, '{separator}') within group (order by {order})"
    parts = by_block.groupBy(key, "_block").agg(F.expr(part).alias("_part"))
    whole = f"listagg(_part, '{separator}') within group (order by _block)"
    return parts.groupBy(key).agg(F.expr(whole).alias(alias))


def _pieces(body: Column, separator: str) -> Column:
    """Pieces ended by ``separator``. What follows the last one is unfinished and not looked at."""
    pieces = F.split(body, separator, -1)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def data_lines(raw: DataFrame) -> DataFrame:
    """``data:`` lines of captured response bodies, trimmed, with their line number."""
    lines = raw.select("call_id", F.posexplode(_pieces(F.col("body"), "\n")).alias("seq", "_line"))
    trimmed = lines.select("call_id", "seq", strip(F.col("_line")).alias("_line"))
    return trimmed.where(F.col("_line").startswith("data:")).select(
        "call_id", "seq", strip(F.substring("_line", 6, 2**31 - 1)).alias("data")
    )


def frames(raw: DataFrame) -> DataFrame:
    """Event frames of captured bodies: last event name (default ``message``) and the joined data, if that is JSON."""
    split = raw.select("call_id", F.posexplode(_pieces(F.col("body"), "\n\n")).alias("seq", "_frame"))
    lines = F.split("_frame", "\n", -1)

    def values(prefix: str) -> Column:
        wanted = F.filter(lines, lambda line: line.startswith(prefix))
        return F.transform(wanted, lambda line: strip(F.substring(line, len(prefix) + 1, 2**31 - 1)))

    named = split.select(
        "call_id",
        "seq",
        F.coalesce(F.try_element_at(values("event:"), F.lit(-1)), F.lit("message")).alias("event"),
        F.array_join(values("data:"), "").alias("data"),
    )
    return named.where((F.col("data") != "") & strict(F.col("data")).isNotNull())


def split_system(messages: Column) -> Column:
    """System messages of a prompt joined by newlines (null if empty), and the other messages."""
    system = F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"])
    return F.struct(
        _filled(F.array_join(system, "\n")).alias("system"),
        F.filter(messages, lambda m: m["role"] != "system").alias("messages"),
    )


def system_prompts(messages: DataFrame) -> DataFrame:
    """The relational form, per conversation of a transcript."""
    said = messages.withColumn("content", F.expr("if(role = 'system', content, null)"))
    joined = join_text(said, "conversation_id", "turn", "content", "\\n", "system")
    return joined.withColumn("system", _filled(F.col("system")))
