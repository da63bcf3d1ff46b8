"""Redaction of table columns and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callgauge.functions.redact import RULES, redact, rule_hits, steps, was_redacted

PREVIEWS = ("input_preview", "output_preview")


def apply(df: DataFrame, columns: tuple[str, ...] = PREVIEWS, flag: str = "pii_redacted") -> DataFrame:
    """Scrubs ``columns`` and sets ``flag`` where any of them changed. Previews only, unless told otherwise.

    The steps are columns of their own: all in one, two texts made a method of 11,772 bytes, which the JVM does not compile.
    """
    clean = df.select("*", *[F.col(c).alias(f"_clean_{c}") for c in columns])
    for turn in zip(*[steps(F.col(c)) for c in columns]):
        clean = clean.withColumns({f"_clean_{c}": step(F.col(f"_clean_{c}")) for c, step in zip(columns, turn)})
    hit = F.lit(False)
    for c in columns:
        hit = hit | was_redacted(F.col(c), F.col(f"_clean_{c}"))
    kept = [F.col(f"_clean_{c}").alias(c) if c in columns else F.col(c) for c in df.columns if c != flag]
    return clean.select(*kept, hit.alias(flag))


def stats(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Per group: rows, rows flagged, their share, and hits of each rule."""
    clean = df.select(*keys, text, redact(F.col(text)).alias("_clean"))
    hits = [F.sum(rule_hits(F.col(text), F.col("_clean"), rule)).alias(f"{rule.lower()}_hits") for rule in RULES]
    flagged = F.count_if(was_redacted(F.col(text), F.col("_clean")))
    return clean.groupBy(*keys).agg(
        F.count("*").alias("texts"), flagged.alias("flagged"), (flagged / F.count("*")).alias("flagged_share"), *hits
    )
