"""Number handling of the dashboard."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, functions as F

from callgauge.functions.text import strip

# The trailing window in minutes, its bounds, and the presets of the window switch.
DEFAULT_MINUTES = 60
MIN_MINUTES = 5
MAX_MINUTES = 1440
WINDOW_PRESETS = {"15m": 15, "1h": 60, "6h": 360, "24h": 1440}

#: Error rates above this are shown as an alert.
ALERT_ERROR_RATE = 0.1

_DECIMAL = re.compile(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)")


def clamp_minutes(raw: str | float | None) -> float:
    """Window length from a request argument: missing means the default, anything that is no number the lower bound."""
    if raw is None:
        return DEFAULT_MINUTES
    if isinstance(raw, str):
        text = raw.strip()
        if not text:
            raw = 0.0
        elif _DECIMAL.fullmatch(text):
            raw = float(text)
        else:
            return MIN_MINUTES
    if not math.isfinite(raw):
        return MIN_MINUTES
    value = max(MIN_MINUTES, min(MAX_MINUTES, raw))
    return int(value) if float(value).is_integer() else value


def clamp_minutes_col(raw: Column) -> Column:
    """Column form of :func:`clamp_minutes` over request arguments held as text."""
    text = strip(raw)
    # a cast takes more spellings than numbers have: 100d, 90f
    parsed = F.when(text == "", F.lit(0.0)).when(text.rlike(f"^(?:{_DECIMAL.pattern})$"), text.try_cast("double"))
    finite = F.abs(parsed) != float("inf")
    clamped = F.greatest(F.lit(float(MIN_MINUTES)), F.least(F.lit(float(MAX_MINUTES)), parsed))
    return (
        F.when(raw.isNull(), F.lit(float(DEFAULT_MINUTES)))
        .when(finite, clamped)
        .otherwise(F.lit(float(MIN_MINUTES)))
    )


def round_half_up(value: Column) -> Column:
    """Nearest integer, halves up, null stays null.

    Interpolated percentiles come out a few ulps off an exact half depending on the order of the float operations, so
    they are first rounded to six digits.
    """
    return F.floor(F.round(value, 6) + F.lit(0.5)).cast("bigint")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def error_tone(error_rate: Column) -> Column:
    return F.when(error_rate > ALERT_ERROR_RATE, F.lit("alert")).otherwise(F.lit("ok"))


def compact_number(n: Column) -> Column:
    """``999`` stays, ``12345`` becomes ``12.3k``. ``n`` is an integer.

    Tenths are those of the binary value of n / 1000, which for a decimal half is a hair above or below it: 1150 is shown
    as 1.1k, 1350 as 1.4k. The sign of that hair is taken exactly, by splitting the quotient in two halves whose products
    have no rounding.
    """
    x, twentieths = n / F.lit(1000), F.round(n / F.lit(50)).cast("double")
    high = x * 134217729.0 - (x * 134217729.0 - x)
    above = (high * 20.0 - twentieths) + (x - high) * 20.0 >= 0
    up = F.when(F.pmod(n, F.lit(100)) == 50, above).otherwise(F.pmod(n, F.lit(100)) > 50)
    tenths = F.floor(n / F.lit(100)) + up.cast("bigint")
    shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("k"))
    return F.when(n >= 1000, shown).otherwise(n.cast("string"))
