"""Token estimates for calls whose provider reports no usage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Characters per token, and tokens a chat message adds to its text.
CHARS_PER_TOKEN = 4
MESSAGE_OVERHEAD = 4


@dataclass(frozen=True)
class Estimator:
    """Counts the tokens of a text, and of a prompt held as an array of (role, content)."""

    text: Callable[[Column], Column]
    prompt: Callable[[Column], Column]


def estimate_tokens(text: Column) -> Column:
    """Rough count from the length; 0 for null or empty text."""
    return F.coalesce(F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)), F.lit(0)).cast("bigint")


def estimate_prompt(messages: Column) -> Column:
    """Sum over the messages, each with its overhead."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(messages, zero, lambda n, m: n + estimate_tokens(m["content"]) + F.lit(MESSAGE_OVERHEAD))


BY_LENGTH = Estimator(estimate_tokens, estimate_prompt)
