"""Reading log envelopes from batches, bus entries and payload text, and writing them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions.json import only_value, readings
from callgauge.operators.once import once
from callgauge.schemas import ENVELOPE

PAYLOAD = "payload"


def parse(df: DataFrame, text: str = PAYLOAD, alias: str = "log", keep: bool = False) -> DataFrame:
    """Replaces a column of JSON text by its VARIANT, null if it is no JSON or has text after its value."""
    rest = [c for c in df.columns if c != alias and (keep or c != text)]
    listed, closed = readings(F.col(text))
    read = once(df, _listed=listed, _closed=closed)
    return read.select(*rest, only_value(F.col("_listed"), F.col("_closed")).alias(alias))


def explode_batches(batches: DataFrame) -> DataFrame:
    """One row per log of ``batch`` (VARIANT), with its position, next to the batch's other columns."""
    logs = F.try_variant_get(F.col("batch"), "$.logs", "array<variant>")
    rest = [c for c in batches.columns if c != "batch"]
    return batches.select(*rest, F.posexplode(logs).alias("position", "log"))


def payload_field(fields: Column, key: str = PAYLOAD) -> Column:
    """Value of the first ``key`` in a flat list of names and values; null if it is missing.

    Only every other entry is a name: a value that reads like the key is none.
    """
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(fields) - 1, F.lit(0))), lambda i: i % 2 == 0)
    named = F.filter(starts, lambda i: F.get(fields, i) == key)
    # mostly it is the first name, which needs no search
    return F.when(F.get(fields, F.lit(0)) == key, F.get(fields, F.lit(1))).otherwise(F.get(fields, F.get(named, F.lit(0)) + 1))


def entries_with_payload(entries: DataFrame, fields: str = "fields") -> DataFrame:
    """Entries without a payload, or with an empty one, are acknowledged and forgotten."""
    return entries.withColumn(PAYLOAD, payload_field(F.col(fields))).where(F.coalesce(PAYLOAD, F.lit("")) != "")


def to_payload(logs: DataFrame) -> Column:
    """A log row as envelope JSON. Absent values are left out, times are UTC with a ``Z``."""
    columns = []
    for field in ENVELOPE:
        if field.column not in logs.columns:
            continue
        value = F.col(field.column)
        if field.kind == "time":
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        if field.kind == "object":
            value = F.try_parse_json(value)
        columns.append(value.alias(field.name))
    return F.to_json(F.struct(*columns))


def to_events(logs: DataFrame) -> DataFrame:
    """Validated logs as bus records. The key keeps copies of one log on one partition."""
    return logs.select(F.col("request_id").alias("key"), to_payload(logs).alias("value"))
