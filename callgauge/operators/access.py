"""Access paths of the log table.

There are no indexes to keep: the table is partitioned by ``requested_date``, sorted within files, and each path below
is a predicate the Parquet scan can skip row groups by.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.operators.metrics import in_window


def newest_first(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """All rows in order, or with a limit a top-k that sorts nothing in full."""
    ordered = logs.orderBy(F.desc("requested_at"), "request_id")
    return ordered if limit is None else ordered.limit(limit)


def by_time(logs: DataFrame, as_of: datetime, minutes: float, limit: int | None = None) -> DataFrame:
    return newest_first(in_window(logs, as_of, minutes), limit)


def of_provider_model(logs: DataFrame, provider: str, model: str, limit: int | None = None) -> DataFrame:
    return newest_first(logs.where((F.col("provider") == provider) & (F.col("model") == model)), limit)


def of_conversation(logs: DataFrame, conversation_id, limit: int | None = None) -> DataFrame:
    return newest_first(logs.where(F.col("conversation_id") == F.lit(conversation_id)), limit)


def errors(logs: DataFrame, limit: int | None = None) -> DataFrame:
    return newest_first(logs.where(F.col("status") == "error"), limit)


def metadata_value(metadata: Column, path: str, as_type: str) -> Column:
    """A typed value out of the JSON text; null if it is absent or of another type."""
    return F.try_variant_get(F.try_parse_json(metadata), path, as_type)


def with_metadata(logs: DataFrame, path: str, value, as_type: str) -> DataFrame:
    """Rows whose metadata holds ``value`` at ``path``.

    Text without the key's name is not parsed. A name may be spelled with escapes, so text with a backslash always is.
    """
    if named := re.fullmatch(r"\$\.(\w+)", path, re.ASCII):
        text = F.col("metadata")
        logs = logs.where(text.contains(f'"{named[1]}"') | text.contains("\\"))
    return logs.where(metadata_value(F.col("metadata"), path, as_type) == F.lit(value))
