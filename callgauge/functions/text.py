"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters the event producer's language counts as white space. Java's \s knows only ASCII ones.
WHITESPACE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
BLANKS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def first_text(*columns: Column) -> Column:
    """First non-empty value, '' if there is none."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def minute_label(bucket: Column) -> Column:
    return F.date_format(bucket, "HH:mm")


def strip(text: Column) -> Column:
    """Trim white space of every kind at both ends, in linear time."""
    return F.btrim(text, F.lit(BLANKS))


def cut(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)
