"""JSON text read strictly."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strict(text: Column) -> Column:
    """The text's only JSON value as VARIANT, null if it is none or anything but white space follows it.

    A JSON reader stops after the first value. So the text is read as the only entry of a list and as the only field of
    an object: a text that ends the list early breaks the object and the other way round.
    """
    return only_value(*readings(text))


def readings(text: Column) -> tuple[Column, Column]:
    """The text as a list of VARIANT, and whether it is one field of an object: what :func:`only_value` takes."""
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<variant>")
    return listed, F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()


def only_value(listed: Column, closed: Column) -> Column:
    return F.when((F.size(listed) == 1) & closed, F.get(listed, F.lit(0)))
