"""Latency quantiles from sketches that add up, for tables whose exact histograms have too many distinct latencies.

A sketch is a latency histogram (``metrics.latency_histogram``) in which every latency stands at the middle of its slot.
Latencies below ``2^(BITS + 1)`` have a slot each; above, every power of two is cut into ``2^BITS`` slots of equal width.
So a group holds at most ``SLOTS`` rows whatever its latencies are, and sketches of any groups, batches or minutes are
merged by adding their counts up, in whatever order, with the same result.

Counts are exact, so the slot in which a quantile lies is the right one; the latency given for it is off by no more than
``ERROR`` of itself (1/256), and an interpolated quantile by no more than that of the larger of its two neighbours.
Rounding to whole milliseconds adds half a millisecond at most. Negative latencies are treated by their absolute value,
null latencies count in the totals only, and an empty table gives an empty sketch.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from callgauge.functions.numbers import WINDOW_PRESETS
from callgauge.operators import metrics

BITS = 7
ERROR = 2.0 ** -(BITS + 1)
#: Slots of either sign that 64-bit latencies can have.
SLOTS = 2 ** (BITS + 1) + (63 - BITS - 1) * 2**BITS


def middle(value: Column | str) -> Column:
    """The middle of the slot a whole number falls into, bigint."""
    value = F.col(value) if isinstance(value, str) else value
    whole = value.cast("bigint")
    size = F.abs(whole)
    shift = F.length(F.bin(size)) - F.lit(BITS + 1)
    low = F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)
    coarse = low + F.call_function("shiftleft", F.lit(1).cast("bigint"), shift - F.lit(1))
    return F.when(size < 2 ** (BITS + 1), whole).otherwise(F.signum(whole).cast("bigint") * coarse)


def of_logs(logs: DataFrame, *keys: str) -> DataFrame:
    """The sketch of each group of calls, in one aggregate combined on the map side."""
    return metrics.latency_histogram(logs.withColumn("latency_ms", middle("latency_ms")), *keys)


def of_histogram(histogram: DataFrame, *keys: str) -> DataFrame:
    """The sketch of exact counts, such as those the ingest job keeps by minute, or of sketches put together.

    A middle lies in its own slot and is its middle again, so sketches pass unchanged.
    """
    return metrics.latency_histogram_sum(histogram.withColumn("latency_ms", middle("latency_ms")), *keys)


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Totals, p50, p95, p99 and mean time to first token per ``keys``, of all sketches with these keys together."""
    return metrics.from_histogram(sketch, *keys)


def store(sketch: DataFrame, path: str, mode: str = "append") -> None:
    """Appends sketches by minute (``bucket``) to a table that is partitioned by date."""
    dated = sketch.withColumn("requested_date", F.to_date("bucket"))
    dated.repartition("requested_date", F.hour("bucket")).write.mode(mode).partitionBy("requested_date").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def by_preset(sketch: DataFrame, as_of: datetime) -> DataFrame:
    """A row per window preset from sketches by minute, in one scan of the longest window.

    A window starts with the full minute in which ``as_of`` lies, less its length.
    """
    newest = as_of.replace(second=0, microsecond=0)
    kept = metrics.in_window(sketch, newest, max(WINDOW_PRESETS.values()), "bucket")
    kind = sketch.schema["bucket"].dataType
    windows = F.array(
        *[
            F.struct(
                F.lit(name).alias("preset"),
                F.lit(minutes).alias("minutes"),
                F.lit((newest - timedelta(minutes=minutes)).isoformat(sep=" ")).cast(kind).alias("start"),
            )
            for name, minutes in WINDOW_PRESETS.items()
        ]
    )
    inside = F.explode(F.filter(windows, lambda w: w["start"] <= F.col("bucket"))).alias("window")
    each = kept.select("*", inside).select("window.preset", "window.minutes", "latency_ms", *metrics.ADDITIVE)
    return quantiles(each, "preset", "minutes")
