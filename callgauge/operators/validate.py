"""Strict checks of log envelopes.

Envelopes are read as VARIANT: a typed JSON reader gives null for an absent key, a JSON null and a wrong type alike,
and only the first of these is allowed for an optional key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.operators.once import once
from callgauge.schemas import ENVELOPE, INT_COLUMNS, INT_MAX, MAX_BATCH, MAX_ISSUES, STATUSES, UTC_TIME, UUID, Field

INVALID_TYPE, TOO_SMALL, TOO_BIG = "invalid_type", "too_small", "too_big"
INVALID_STRING, INVALID_ENUM = "invalid_string", "invalid_enum_value"


def _longer_than(text: Column, limit: int) -> Column:
    """Whether the producer counts more than ``limit``: in UTF-16, where characters off the basic plane count twice.

    A text never has more UTF-16 units than UTF-8 bytes, so only one with more bytes is recoded.
    """
    units = F.octet_length(F.encode(text, "UTF-16BE")) / F.lit(2)
    return F.when(F.octet_length(text) > limit, units > limit).otherwise(F.lit(False))


#: Every key of an envelope as VARIANT: null if it is absent, a VARIANT null if it is null.
FIELDS = "struct<" + ", ".join(f"{f.column}: variant" for f in ENVELOPE) + ">"
_KEYED = "struct<" + ", ".join(f"{f.name}: variant" for f in ENVELOPE) + ">"


def _fields(log: Column) -> Column:
    """All keys in one go, null if the envelope is no object. Reading them by path one by one costs several times more."""
    return F.try_variant_get(log, "$", _KEYED).cast(FIELDS)


def _reads(fields: Column) -> Column:
    """What the checks look at, read once per key: the JSON type (null if absent) and the value."""
    reads = []
    for field in ENVELOPE:
        value = fields[field.column]
        reads.append(F.schema_of_variant(value).alias(f"{field.column}_type"))
        if field.kind == "object":
            reads.append(F.to_json(value).alias(field.column))
        else:
            reads.append(F.try_variant_get(value, "$", READ_AS.get(field.kind, "string")).alias(field.column))
    return F.struct(fields.isNotNull().alias("is_object"), *reads)


#: Numbers are doubles, as they are to the producer.
READ_AS = {"int": "double", "bool": "boolean"}


def _codes(read: Column, field: Field) -> list[Column]:
    """Issue codes of one key, null where it is fine; a number may fail two checks at once."""
    held = read[f"{field.column}_type"]
    absent = F.lit(INVALID_TYPE if field.required else None).cast("string")
    fine = F.lit(None).cast("string")

    def typed(matches: Column, code: Column) -> Column:
        return F.when(held.isNull(), absent).when(~matches, F.lit(INVALID_TYPE)).otherwise(code)

    if field.kind == "bool":
        return [typed(held == "BOOLEAN", fine)]
    if field.kind == "object":
        return [typed(held.startswith("OBJECT"), fine)]
    value = read[field.column]
    if field.kind == "int":
        is_number = held.isin("BIGINT", "DOUBLE", "FLOAT") | held.startswith("DECIMAL")
        whole = (value == F.floor(value)) & (F.abs(value) != float("inf"))
        return [
            typed(is_number, F.when(~whole, F.lit(INVALID_TYPE))),
            F.when(is_number & (value < 0), F.lit(TOO_SMALL)),
        ]
    if field.kind == "str":
        empty = F.octet_length(value) < field.shortest
        code = F.when(empty, F.lit(TOO_SMALL)).when(_longer_than(value, field.longest), F.lit(TOO_BIG))
    elif field.kind == "uuid":
        code = F.when(~value.rlike(UUID), F.lit(INVALID_STRING))
    elif field.kind == "status":
        code = F.when(~value.isin(*STATUSES), F.lit(INVALID_ENUM))
    else:
        real_day = F.substring(value, 1, 10).try_cast("date").isNotNull()
        code = F.when(~(value.rlike(UTC_TIME) & real_day), F.lit(INVALID_STRING))
    return [typed(held == "STRING", code)]


def _issues(read: Column, path: Column | None = None) -> Column:
    """Issues of one envelope as array of (path, code), in the order of the keys."""
    prefix = F.lit("") if path is None else F.concat(path, F.lit("."))
    root = F.lit("") if path is None else path
    codes = [(field.name, code) for field in ENVELOPE for code in _codes(read, field)]
    fine = F.coalesce(*[code for _, code in codes]).isNull()
    found = F.array(*[_issue(F.concat(prefix, F.lit(name)), code) for name, code in codes])
    return (
        F.when(~read["is_object"], F.array(_issue(root, F.lit(INVALID_TYPE))))
        .when(fine, F.array().cast("array<struct<path:string,code:string>>"))
        .otherwise(F.filter(found, lambda issue: issue["code"].isNotNull()))
    )


def _issue(path: Column, code: Column) -> Column:
    return F.struct(path.alias("path"), code.alias("code"))


def _batch_issues(logs: Column, held: Column) -> Column:
    """Issues of a ``{"logs": [...]}`` batch, its size first."""
    is_list = F.coalesce(held.startswith("ARRAY"), F.lit(False))
    size_code = F.when(F.size(logs) < 1, F.lit(TOO_SMALL)).when(F.size(logs) > MAX_BATCH, F.lit(TOO_BIG))

    def at_root(code: Column) -> Column:
        return F.array(F.when(code.isNotNull(), _issue(F.lit("logs"), code)))

    reads = F.transform(F.transform(logs, _fields), _reads)
    inner = F.flatten(F.transform(reads, lambda read, i: _issues(read, F.concat(F.lit("logs."), i.cast("string")))))
    return F.when(is_list, F.concat(F.array_compact(at_root(size_code)), inner)).otherwise(at_root(F.lit(INVALID_TYPE)))


def first_issues(issues: Column) -> Column:
    """What a rejected sender is told."""
    return F.slice(issues, 1, MAX_ISSUES)


def _read(envelopes: DataFrame) -> DataFrame:
    return once(once(envelopes, _fields=_fields(F.col("log"))), _read=_reads(F.col("_fields"))).drop("_fields")


def check(envelopes: DataFrame, with_columns: bool = False) -> DataFrame:
    """Adds ``issues`` to envelopes with the VARIANT column ``log``; the good ones have none.

    ``with_columns`` adds the stored columns too, out of the same reading.

    They are worked out in a projection of their own and only opened by the generator: a generator with a lambda function in
    it is interpreted, all of it, a projection is compiled around the lambda.
    """
    read = _read(envelopes)
    stored = typed(F.col("_read")) if with_columns else {}
    rest = [c for c in read.columns if c not in ("_read", "issues", *stored)]
    made = F.struct(_issues(F.col("_read")).alias("issues"), *[value.alias(c) for c, value in stored.items()])
    return once(read.select(*rest, made.alias("_checked")), **{c: F.col("_checked")[c] for c in ("issues", *stored)}).drop("_checked")


def typed_rows(envelopes: DataFrame) -> DataFrame:
    """Replaces ``log`` by the stored columns without any check: what does not read as its type is null."""
    rest = [c for c in envelopes.columns if c != "log"]
    return _read(envelopes).select(*rest, *[value.alias(c) for c, value in typed(F.col("_read")).items()])


def check_batches(batches: DataFrame) -> DataFrame:
    """The same for batches with the VARIANT column ``batch``. One bad log makes the whole batch bad.

    A batch is a single row, so this needs no shuffle. It is opened into its logs only afterwards.
    """
    opened = once(
        batches,
        _logs=F.try_variant_get(F.col("batch"), "$.logs", "array<variant>"),
        _held=F.schema_of_variant(F.try_variant_get(F.col("batch"), "$.logs", "variant")),
    )
    return once(opened, issues=_batch_issues(F.col("_logs"), F.col("_held"))).drop("_logs", "_held")


def strip_unknown(log: Column) -> Column:
    """The envelope as JSON text with only the listed keys."""
    return F.to_json(F.try_variant_get(log, "$", _KEYED))


def typed(read: Column) -> dict[str, Column]:
    """Stored columns with the defaults of absent keys. Whole numbers are BIGINT until their range is checked."""
    columns = {}
    for field in ENVELOPE:
        value = read[field.column]
        if field.kind == "int":
            value = value.try_cast("bigint")
        elif field.kind == "time":
            value = F.try_to_timestamp(value)
        elif field.kind == "bool":
            value = F.coalesce(value, F.lit(False))
        elif field.kind == "object":
            value = F.coalesce(value, F.lit("{}"))
        columns[field.column] = value
    return columns


def out_of_range() -> Column:
    """Whole numbers an INT column cannot hold. The edge check lets them through, so they are set aside here."""
    bad = F.lit(False)
    for c in INT_COLUMNS:
        bad = bad | F.coalesce(F.col(c) > INT_MAX, F.lit(False))
    return bad
