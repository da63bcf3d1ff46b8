"""Conversations and their messages.

Messages carry ``conversation_id``, ``turn`` (their order within the conversation), ``role``, ``content`` and
``created_at``. The conversation table is never updated in place: :func:`state` folds its event history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from callgauge.functions.redact import redact
from callgauge.functions.text import cut, strip
from callgauge.operators.hotkeys import BLOCK, over_neighbours

# Fixed values.
LIST_LIMIT = 200
CONTEXT_MESSAGES = 20
TITLE_LENGTH = 60
PREVIEW_LENGTH = 500

FOLDED = ("title", "model", "provider")


def state(events: DataFrame) -> DataFrame:
    """Current row per conversation from create, message, meta and cancel events.

    Title, model and provider keep their last non-null value, a cancel latches, and every event counts as a touch. All
    of it is partial aggregation by ``seq``, so a long conversation is reduced before the shuffle.
    """
    known = [c for c in FOLDED if c in events.columns]
    last = [F.expr(f"max_by({c}, seq) filter (where {c} is not null)").alias(c) for c in known]
    cancelled = F.bool_or(F.col("kind") == "cancel")
    return events.groupBy("conv_id").agg(
        *last,
        F.when(cancelled, F.lit("cancelled")).otherwise(F.lit("active")).alias("status"),
        F.min("event_at").alias("created_at"),
        F.max("event_at").alias("updated_at"),
    )


def list_conversations(conversations: DataFrame, messages: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Newest conversations with their number of non-system messages.

    The order does not need the counts, so the newest are picked first, and of their messages alone (``limit`` ids are
    sent to the scan) the counts are made.
    """
    newest = conversations.orderBy(F.desc("updated_at"), "conv_id").limit(limit)
    counts = (
        messages.where(F.col("role") != "system")
        .select(F.col("conversation_id").alias("conv_id"))
        .join(F.broadcast(newest.select("conv_id")), "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.count("*").alias("msg_count"))
    )
    counted = newest.join(counts, "conv_id", "left").withColumn("msg_count", F.coalesce("msg_count", F.lit(0)))
    return counted.orderBy(F.desc("updated_at"), "conv_id")


def get(conversations: DataFrame, messages: DataFrame, conversation_id) -> DataFrame:
    """One conversation's header next to each of its messages in time order; no row if it does not exist.

    The messages stay rows: a long transcript is sorted by many tasks and never gathered into one value.
    """
    wanted = F.lit(conversation_id)
    header = conversations.where(F.col("conv_id") == wanted)
    turns = messages.where(F.col("conversation_id") == wanted).select(
        F.col("conversation_id").alias("conv_id"), "turn", "role", "content", F.col("created_at").alias("said_at")
    )
    return header.join(turns, "conv_id", "left").orderBy("said_at", "turn")


def resume_view(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role") != "system").select("conversation_id", "turn", "role", "content")


def context_window(messages: DataFrame, n: int = CONTEXT_MESSAGES, block: int = BLOCK) -> DataFrame:
    """For every user turn the last ``n`` non-system messages up to and including it, oldest first."""
    spoken = messages.where(F.col("role") != "system").select("conversation_id", "turn", "role", "content")

    def gather(rows: DataFrame, groups: list[str]) -> DataFrame:
        span = W.partitionBy(*groups).orderBy("turn").rowsBetween(1 - n, 0)
        return rows.withColumn("context", F.collect_list(F.struct("role", "content")).over(span))

    every = over_neighbours(spoken, "conversation_id", "turn", n - 1, gather, block=block)
    return every.where(F.col("role") == "user").select("conversation_id", "turn", "context")


def titles(messages: DataFrame) -> DataFrame:
    """Title a conversation gets from its first user message."""
    short = messages.where(F.col("role") == "user").select("conversation_id", "turn", cut(F.col("content"), TITLE_LENGTH).alias("t"))
    return short.groupBy("conversation_id").agg(F.min_by("t", "turn").alias("title"))


def keep_title(title: Column, first_message: Column) -> Column:
    """A title once set stays."""
    return F.coalesce(F.nullif(title, F.lit("")), cut(first_message, TITLE_LENGTH))


def accept_turns(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Outcome of each requested turn (``conv_id``, ``message``): accepted, or why it is refused."""
    known = conversations.select("conv_id", F.col("status").alias("_status"))
    blank = F.col("message").isNull() | (strip(F.col("message")) == "") | F.col("conv_id").isNull()
    outcome = (
        F.when(blank, F.lit("bad_request"))
        .when(F.col("_status").isNull(), F.lit("not_found"))
        .when(F.col("_status") == "cancelled", F.lit("conversation_cancelled"))
        .otherwise(F.lit("accepted"))
    )
    return turns.join(known, "conv_id", "left").withColumn("outcome", outcome).drop("_status")


def cascade_delete(messages: DataFrame, purged: DataFrame) -> DataFrame:
    """Messages left once the conversations of ``purged`` (``conv_id``) are deleted. Logs are not touched."""
    gone = purged.select(F.col("conv_id").alias("conversation_id"))
    return messages.join(gone, "conversation_id", "left_anti")


def logs_with_conversation(logs: DataFrame, conversations: DataFrame) -> DataFrame:
    """Soft link: logs without a conversation keep their row."""
    header = conversations.select(
        F.col("conv_id").alias("conversation_id"), "title", F.col("status").alias("conversation_status")
    )
    return logs.join(header, "conversation_id", "left")


def orphan_logs(logs: DataFrame, conversations: DataFrame) -> DataFrame:
    """Logs that name a conversation which is gone."""
    return logs.where(F.col("conversation_id").isNotNull()).join(conversations.select(F.col("conv_id").alias("conversation_id")), "conversation_id", "left_anti")


def partial_turns(logs: DataFrame, messages: DataFrame, preview: int = PREVIEW_LENGTH) -> DataFrame:
    """Cancelled calls whose partial reply was saved as an assistant message at or after the request.

    The link is an equality on (conversation, start of the text as the log stores it). Messages are reduced to the last
    time each such text was saved before joining, so a conversation that repeats a text does not multiply rows.
    """
    cut_off = logs.where((F.col("status") == "cancelled") & (F.coalesce("output_preview", F.lit("")) != ""))
    # only texts of conversations with such a call are redacted and moved
    saved = (
        messages.where(F.col("role") == "assistant")
        .join(cut_off.select("conversation_id").distinct(), "conversation_id", "left_semi")
        .groupBy("conversation_id", redact(cut(F.col("content"), preview)).alias("output_preview"))
        .agg(F.max("created_at").alias("saved_at"))
    )
    return cut_off.join(saved, ["conversation_id", "output_preview"]).where(F.col("saved_at") >= F.col("requested_at"))


def conversation_usage(logs: DataFrame, conversations: DataFrame) -> DataFrame:
    """Calls, errors, tokens and latency per conversation, with its title where it still exists."""
    used = logs.groupBy("conversation_id").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        F.sum("latency_ms").alias("latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.max("requested_at").alias("last_request"),
    )
    return logs_with_conversation(used, conversations)
