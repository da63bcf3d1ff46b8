"""Containment of JSON in JSON, by the rules document databases use.

An object contains another if it has all its keys and their values contain the other's. An array contains another if each of
the other's elements is contained in one of its own, in whatever order and however often. Other values contain what equals
them, numbers by their value (1 is 1.0), text by its characters. At the top an array contains a single value that is one of
its elements. Of a repeated key the last value counts.

Null, empty text and text that is no JSON contain nothing and are contained nowhere; so are numbers beyond the decimal
library's exponents and values nested deeper than Python's parser goes (1,000 levels and more). Work is linear in a text.
"""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, functions as F

#: Levels of what can be asked for.
DEEPEST = 100


class _NotJson:
    pass


#: A class, as it stays the same object on the executors.
NOT_JSON = _NotJson


def _no_constant(name: str):
    raise ValueError(name)


def parse(text: str | None):
    """The value, its numbers as decimals, or ``NOT_JSON``."""
    try:
        return json.loads(text, parse_int=Decimal, parse_float=Decimal, parse_constant=_no_constant)
    except (TypeError, ValueError, ArithmeticError, RecursionError):
        return NOT_JSON


def _equal(a, b) -> bool:
    # bool is a number to Python
    return type(a) is type(b) and a == b


def contains(whole, part, top: bool = True) -> bool:
    """Whether a parsed value contains another."""
    if whole is NOT_JSON or part is NOT_JSON:
        return False
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and contains(whole[k], v, False) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(contains(w, p, False) for w in whole) for p in part)
    if isinstance(whole, list):
        return top and any(_equal(w, part) for w in whole)
    return _equal(whole, part)


def _number(value: Decimal) -> str:
    sign, digits, exponent = value.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    cut = text.rstrip("0")
    return f"{'-' * sign}{cut}e{exponent + len(text) - len(cut)}" if cut else "0"


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=8).digest()


def _scalar(value) -> bytes:
    return f"n{_number(value)}".encode() if isinstance(value, Decimal) else json.dumps(value).encode()


def asked(value) -> set[int]:
    """Hashes of every place in a value: path and scalar, and every object and array. Zero is never one of them.

    What contains the value has all of them; what has them all need not contain it, as they may be of different elements.
    """
    found, open_ = set(), [(value, b"")]
    while open_:
        inner, path = open_.pop()
        if isinstance(inner, dict):
            found.add(_hash(path, b"{"))
            open_ += [(v, _hash(path, b".", json.dumps(k).encode())) for k, v in inner.items()]
        elif isinstance(inner, list):
            found.add(_hash(path, b"["))
            step = _hash(path, b"[]")
            open_ += [(v, step) for v in inner]
        else:
            found.add(_hash(path, b"=", _scalar(inner)))
    return {int.from_bytes(f, "big", signed=True) for f in found} - {0}


def terms(whole) -> set[int]:
    """Every hash that anything ``whole`` contains can be asked by."""
    if whole is NOT_JSON:
        return set()
    found = asked(whole)
    if isinstance(whole, list):
        # a single value that an array at the top contains
        for inner in whole:
            if not isinstance(inner, (dict, list)):
                found |= asked(inner)
    return found


def wanted(text: str):
    """The value of what is asked for, which must be JSON of at most ``DEEPEST`` levels."""
    value = parse(text)
    level, levels = [value], 0
    while level:
        levels += 1
        level = [v for inner in level if isinstance(inner, (dict, list)) for v in (inner.values() if isinstance(inner, dict) else inner)]
    if value is NOT_JSON or levels > DEEPEST:
        raise ValueError(f"not JSON of at most {DEEPEST} levels")
    return value


def json_contains(column: Column | str, part: str) -> Column:
    """Whether JSON text contains ``part`` (JSON text); false for null. Batches go through Arrow, repeated texts are read once."""
    value = wanted(part)

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        codes, different = pd.factorize(texts)
        held = pd.Series([contains(parse(t), value) for t in different] + [False], dtype=bool)
        return held.iloc[codes].reset_index(drop=True)

    return run(F.col(column) if isinstance(column, str) else column)
