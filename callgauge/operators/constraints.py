"""Table constraints as data checks: a row count per rule, 0 when it holds."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.schemas import CONVERSATION_STATUSES, ROLES, STATUSES

REQUIRED = {
    "logs": ("request_id", "provider", "model", "streaming", "status", "tokens_estimated", "pii_redacted", "requested_at",
             "metadata", "ingested_at"),
    "messages": ("conversation_id", "role", "content", "created_at"),
    "conversations": ("status", "created_at", "updated_at"),
}
ALLOWED = {"logs": ("status", STATUSES), "messages": ("role", ROLES), "conversations": ("status", CONVERSATION_STATUSES)}
UNIQUE = {"logs": ["request_id"], "messages": ["conversation_id", "turn"], "conversations": ["conv_id"]}


def _rules(name: str, df: DataFrame) -> DataFrame:
    """NOT NULL, CHECK and UNIQUE rules from one scan: rows are counted by key, and the counts added up.

    UNIQUE does not compare keys with a null in them.
    """
    if missing := {*REQUIRED[name], *UNIQUE[name], ALLOWED[name][0]} - set(df.columns):
        raise ValueError(f"{name} has no column {', '.join(sorted(missing))}")
    column, words = ALLOWED[name]
    rules: dict[str, Column] = {f"{c} not null": F.col(c).isNull() for c in REQUIRED[name]}
    rules[f"{column} check"] = F.col(column).isNotNull() & ~F.col(column).isin(*words)
    by_key = df.groupBy(*UNIQUE[name]).agg(
        F.when(reduce(or_, [F.col(c).isNull() for c in UNIQUE[name]]), 0).otherwise(F.count("*") - 1).alias("_copies"), *[F.count_if(bad).alias(rule) for rule, bad in rules.items()]
    )
    unique = f"{', '.join(UNIQUE[name])} unique"
    counted = by_key.agg(
        *[F.coalesce(F.sum(F.col(f"`{rule}`")), F.lit(0)).alias(rule) for rule in rules],
        F.coalesce(F.sum("_copies"), F.lit(0)).alias(unique),
    )
    pairs = F.explode(F.create_map(*[x for rule in (*rules, unique) for x in (F.lit(rule), F.col(f"`{rule}`"))]))
    return counted.select(F.lit(name).alias("table"), pairs.alias("rule", "violations"))


def report(logs: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Violations of every rule. Log rows may point to conversations that are gone, messages may not."""
    tables = {"logs": logs, "messages": messages, "conversations": conversations}
    parent = conversations.select(F.col("conv_id").alias("conversation_id"))
    orphans = messages.join(parent, "conversation_id", "left_anti").agg(F.count("*").alias("violations"))
    out = orphans.select(F.lit("messages").alias("table"), F.lit("conversation_id references").alias("rule"), "violations")
    for name, df in tables.items():
        out = out.union(_rules(name, df))
    return out
