"""The log envelope, its limits, and the stored table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Allowed words and limits of the log envelope.
STATUSES = ("success", "error", "cancelled")
CONVERSATION_STATUSES = ("active", "cancelled")
ROLES = ("system", "user", "assistant")
MAX_BATCH = 500
MAX_ISSUES = 20
INT_MAX = 2**31 - 1
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
UTC_TIME = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?Z$"


@dataclass(frozen=True)
class Field:
    """One key of the envelope: what it must hold and the column it is stored in."""

    name: str
    column: str
    kind: str  # str, uuid, bool, status, int, time, object
    required: bool = False
    shortest: int = 0
    longest: int = INT_MAX


ENVELOPE = (
    Field("requestId", "request_id", "str", True, 1, 128),
    Field("conversationId", "conversation_id", "uuid"),
    Field("messageId", "message_id", "uuid"),
    Field("provider", "provider", "str", True, 1, 64),
    Field("model", "model", "str", True, 1, 128),
    Field("streaming", "streaming", "bool", True),
    Field("status", "status", "status", True),
    Field("errorType", "error_type", "str", longest=64),
    Field("errorMessage", "error_message", "str", longest=2000),
    Field("latencyMs", "latency_ms", "int"),
    Field("ttftMs", "ttft_ms", "int"),
    Field("promptTokens", "prompt_tokens", "int"),
    Field("completionTokens", "completion_tokens", "int"),
    Field("totalTokens", "total_tokens", "int"),
    Field("tokensEstimated", "tokens_estimated", "bool"),
    Field("inputPreview", "input_preview", "str", longest=4000),
    Field("outputPreview", "output_preview", "str", longest=4000),
    Field("requestedAt", "requested_at", "time", True),
    Field("completedAt", "completed_at", "time"),
    Field("metadata", "metadata", "object"),
)
INT_COLUMNS = tuple(f.column for f in ENVELOPE if f.kind == "int")

#: Stored log table. Metadata is JSON text, so that any Parquet reader can read it.
LOG_TABLE = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("conversation_id", T.StringType()),
        T.StructField("message_id", T.StringType()),
        T.StructField("provider", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("streaming", T.BooleanType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
        *[T.StructField(c, T.IntegerType()) for c in INT_COLUMNS],
        T.StructField("tokens_estimated", T.BooleanType(), False),
        T.StructField("input_preview", T.StringType()),
        T.StructField("output_preview", T.StringType()),
        T.StructField("pii_redacted", T.BooleanType(), False),
        T.StructField("requested_at", T.TimestampType(), False),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("metadata", T.StringType(), False),
        T.StructField("ingested_at", T.TimestampType(), False),
        T.StructField("requested_date", T.DateType(), False),
    ]
)
