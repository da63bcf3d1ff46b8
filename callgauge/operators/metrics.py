"""Dashboard aggregates over the log table.

Every aggregate starts from :func:`latency_histogram`, one row per (group, latency in ms). Its rows are added up on the
map side and spread over the reducers by (group, latency), so a group holding most of the table does not end in one
task, and exact percentiles are then taken over counted values instead of over calls.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from callgauge.functions.numbers import WINDOW_PRESETS, clamp_minutes, error_tone, ratio, round_half_up
from callgauge.functions.text import first_text, minute_label
from callgauge.operators.percentiles import percentiles

PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
#: Columns of a histogram that add up, and the totals made of them.
ADDITIVE = ("calls", "errors", "cancelled", "tokens", "ttft_sum", "ttft_calls")
MEASURES = {"total": "calls", "errors": "errors", "cancelled": "cancelled", "tokens": "tokens"}

RECENT_LIMIT = 30
RECENT_COLUMNS = (
    "request_id", "provider", "model", "status", "streaming", "latency_ms", "ttft_ms", "total_tokens", "pii_redacted",
    "input_preview", "output_preview", "error_type", "requested_at",
)


def latest(logs: DataFrame) -> datetime:
    """Newest request time in UTC: the ``as_of`` of a dashboard over a closed table. A live one passes the clock."""
    return logs.agg(F.max("requested_at").cast("timestamp_ntz")).first()[0]


def in_window(logs: DataFrame, as_of: datetime, minutes: float, at: str = "requested_at") -> DataFrame:
    """Calls of the last ``minutes`` before ``as_of``; there is no upper bound.

    The bound is a constant of the column's own type, so it reaches the scan, and it is repeated on the partition
    column where the table has one.
    """
    start = as_of - timedelta(minutes=minutes)
    kept = logs.where(F.col(at) >= F.lit(start.isoformat(sep=" ")).cast(logs.schema[at].dataType))
    if "requested_date" in logs.columns:
        kept = kept.where(F.col("requested_date") >= F.lit(start.date().isoformat()).cast("date"))
    return kept


def latency_histogram(logs: DataFrame, *keys: str | Column) -> DataFrame:
    """Additive measures per (keys, latency_ms). Histograms of finer keys add up to those of coarser ones."""
    streamed = F.when(F.col("streaming"), F.col("ttft_ms"))
    return logs.groupBy(*keys, "latency_ms").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
        F.sum("total_tokens").alias("tokens"),
        F.sum(streamed).alias("ttft_sum"),
        F.count(streamed).alias("ttft_calls"),
    )


def from_histogram(histogram: DataFrame, *keys: str) -> DataFrame:
    """Totals and exact interpolated percentiles per ``keys``; one row, even if empty, when there are no keys."""
    merged = _merge(histogram, *keys)
    measures = {name: F.coalesce(F.sum(column), F.lit(0)) for name, column in MEASURES.items()}
    ttft = F.try_divide(F.sum("ttft_sum"), F.sum("ttft_calls"))
    found = percentiles(merged, list(keys), "latency_ms", "calls", PERCENTILES, **measures, avg_ttft=ttft)
    rounded = [round_half_up(F.col(name)).alias(f"{name}_ms") for name in (*PERCENTILES, "avg_ttft")]
    return found.select(*keys, *MEASURES, *rounded)


def latency_histogram_sum(histogram: DataFrame, *keys: str) -> DataFrame:
    """Histogram of coarser keys, or of several histograms put together."""
    return histogram.groupBy(*keys, "latency_ms").agg(*[F.sum(c).alias(c) for c in ADDITIVE])


def _merge(histogram: DataFrame, *keys: str) -> DataFrame:
    """One that has just these keys already is left alone."""
    if set(histogram.columns) == {*keys, "latency_ms", *ADDITIVE}:
        return histogram
    return latency_histogram_sum(histogram, *keys)


def summary(logs: DataFrame, minutes: float, *keys: str) -> DataFrame:
    """KPI row of a window ``minutes`` long; with ``keys`` one row per key. ``logs`` is the window's content."""
    return with_rates(from_histogram(latency_histogram(logs, *keys), *keys), minutes)


def with_rates(kpis: DataFrame, minutes: float | Column) -> DataFrame:
    """Error rate (0 when empty) and requests per window minute, not per minute with traffic."""
    length = minutes if isinstance(minutes, Column) else F.lit(float(minutes))
    return kpis.withColumns(
        {
            "error_rate": ratio(F.col("errors"), F.col("total")),
            "throughput_rpm": F.col("total") / length,
        }
    )


def bucketed(logs: DataFrame, unit: str = "minute", at: str = "requested_at") -> DataFrame:
    """Adds the start of the time bucket, in the type of the time column."""
    return logs.withColumn("bucket", F.date_trunc(unit, at).cast(logs.schema[at].dataType))


def series(logs: DataFrame, unit: str = "minute") -> DataFrame:
    """Requests, errors and p95 per bucket in time order; buckets without calls are absent."""
    return series_of(latency_histogram(bucketed(logs, unit), "bucket"))


def series_of(histogram: DataFrame) -> DataFrame:
    points = from_histogram(histogram, "bucket")
    return points.select("bucket", F.col("total").alias("requests"), "errors", F.col("p95_ms").alias("p95")).orderBy("bucket")


def by_provider_model(logs: DataFrame) -> DataFrame:
    """Breakdown, busiest first."""
    grouped = from_histogram(latency_histogram(logs, "provider", "model"), "provider", "model")
    return grouped.select(
        "provider", "model", F.col("total").alias("requests"), "errors", "p50_ms", "tokens"
    ).orderBy(F.desc("requests"), "provider", "model")


def recent(logs: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """Newest calls. Sort and limit become one top-k per task, so nothing is sorted in full."""
    return logs.select(*RECENT_COLUMNS).orderBy(F.desc("requested_at"), "request_id").limit(limit)


def dashboard(logs: DataFrame, as_of: datetime, minutes: str | float | None = None) -> dict[str, DataFrame]:
    """The results of one window: ``overview``, which holds summary, series and breakdown from one scan, and ``recent``.

    All share one ``as_of``, so they agree with each other. ``minutes`` is a request's argument and is clamped.
    """
    minutes = clamp_minutes(minutes)
    window = in_window(logs, as_of, minutes)
    return {"overview": overview(window, minutes), "recent": recent(window)}


def by_preset(
    rows: DataFrame,
    as_of: datetime,
    presets: dict[str, int] | None = None,
    at: str = "requested_at",
    count: Callable[..., DataFrame] = latency_histogram,
) -> DataFrame:
    """KPI rows of several windows ending at the same time, from one scan of the widest.

    A row belongs to every preset at least as long as its age. Rows are first counted by (shortest preset, latency), so
    only counts are repeated per preset, never calls. ``count`` is :func:`latency_histogram_sum` for rows that are counts.
    """
    presets = presets or WINDOW_PRESETS
    ordered = sorted(presets.items(), key=lambda item: item[1])
    widest = in_window(rows, as_of, ordered[-1][1], at)
    shortest = F.lit(len(ordered) - 1)
    for rank, (_, length) in reversed(list(enumerate(ordered))):
        start = F.lit((as_of - timedelta(minutes=length)).isoformat(sep=" ")).cast(rows.schema[at].dataType)
        shortest = F.when(F.col(at) >= start, F.lit(rank)).otherwise(shortest)
    counted = count(widest.withColumn("_rank", shortest), "_rank")
    listed = F.array(
        *[F.struct(F.lit(i).alias("at"), F.lit(n).alias("preset"), F.lit(m).alias("minutes")) for i, (n, m) in enumerate(ordered)]
    )
    covering = F.explode(F.filter(listed, lambda p: p["at"] >= F.col("_rank"))).alias("_p")
    spread = counted.select("*", covering).select("*", "_p.preset", "_p.minutes").drop("_p", "_rank")
    # a count of zero for each preset keeps windows without calls in the result
    empty = rows.sparkSession.range(1).select(F.inline(listed)).select("preset", "minutes", F.lit(0).cast("bigint").alias("calls"))
    spread = spread.unionByName(empty, allowMissingColumns=True)
    return with_rates(from_histogram(spread, "preset", "minutes"), F.col("minutes"))


def tone(kpis: DataFrame) -> DataFrame:
    return kpis.withColumn("tone", error_tone(F.col("error_rate")))


def feed(logs: DataFrame) -> DataFrame:
    """One line of text per call for the recent list."""
    return logs.withColumn("feed_text", first_text(F.col("output_preview"), F.col("error_type"), F.col("input_preview")))


def labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", minute_label(F.col("bucket")))


def ingest_lag(logs: DataFrame, unit: str = "minute") -> DataFrame:
    """Delay between request and storage per bucket: calls, p50, p95 and the worst, in ms.

    Lags of a minute or more count in whole seconds, of a day or more in whole minutes, so that a replay of old logs
    does not bring a different lag for every call.
    """
    stored, requested = (F.unix_millis(F.col(c).cast("timestamp")) for c in ("ingested_at", "requested_at"))
    lag, size = stored - requested, F.abs(stored - requested)
    step = F.when(size < 60_000, 1).when(size < 86_400_000, 1000).otherwise(60_000)
    shown = (F.sign(lag) * F.floor(size / step) * step).cast("bigint")
    counted = bucketed(logs, unit).groupBy("bucket", shown.alias("lag_ms")).agg(F.count("*").alias("calls"), F.max(lag).alias("worst"))
    found = percentiles(
        counted, ["bucket"], "lag_ms", "calls", {"p50": 0.5, "p95": 0.95}, calls=F.sum("calls"), max_lag_ms=F.max("worst")
    )
    return found.select(
        "bucket", "calls", round_half_up(F.col("p50")).alias("p50_lag_ms"), round_half_up(F.col("p95")).alias("p95_lag_ms"), "max_lag_ms"
    )


def overview(logs: DataFrame, minutes: float) -> DataFrame:
    """Summary, series and breakdown from a single scan, told apart by ``part``.

    Calls are counted once by (minute, provider, model, latency); only these counts are repeated for the three groupings.
    """
    counted = latency_histogram(bucketed(logs), "bucket", "provider", "model")
    no_time, no_text = F.lit(None).cast(logs.schema["requested_at"].dataType), F.lit(None).cast("string")
    groupings = [
        ("summary", no_time, no_text, no_text),
        ("series", F.col("bucket"), no_text, no_text),
        ("providers", no_time, F.col("provider"), F.col("model")),
    ]
    keys = ("part", "bucket", "provider", "model")
    rows = F.array(*[F.struct(*[c.alias(k) for k, c in zip(keys, (F.lit(name), *group))]) for name, *group in groupings])
    spread = counted.select("latency_ms", *ADDITIVE, F.explode(rows).alias("_g")).select("_g.*", "latency_ms", *ADDITIVE)
    return with_rates(from_histogram(latency_histogram_sum(spread, *keys), *keys), minutes)


def document(logs: DataFrame, as_of: datetime, minutes: str | float | None = None) -> DataFrame:
    """The dashboard's nested JSON document, one row. ``minutes`` is a request's argument and is clamped.

    So the window holds at most a day of minutes, the recent list 30 rows and the breakdown one row per provider and
    model, so the lists that are collected into the row stay small whatever the number of calls.
    """
    minutes = clamp_minutes(minutes)
    window = in_window(logs, as_of, minutes)
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    requests, t = F.col("total").alias("requests"), F.date_format("bucket", stamp).alias("t")

    def entries(part: str, order: list[Column], *columns: str | Column) -> Column:
        """Rows of one part in order; other parts give null, which a list leaves out."""
        entry = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)], F.struct(*columns).alias("row"))
        listed = F.array_sort(F.collect_list(F.when(F.col("part") == part, entry)))
        return F.transform(listed, lambda e: e["row"]).alias(part)

    kpis = ("total", "errors", "cancelled", "error_rate", "throughput_rpm", "tokens", "p50_ms", "p95_ms", "p99_ms", "avg_ttft_ms")
    parts = overview(window, minutes).agg(
        entries("summary", [F.lit(0)], *kpis),
        entries("series", [t], t, requests, "errors", F.col("p95_ms").alias("p95")),
        entries("providers", [-F.col("total"), F.col("provider"), F.col("model")], "provider", "model", requests, "errors", "p50_ms", "tokens"),
    )
    newest = recent(window).withColumn("part", F.lit("recent"))
    newest_first = [-F.unix_micros(F.col("requested_at").cast("timestamp")), F.col("request_id")]
    shown = [F.date_format(c, stamp).alias(c) if c == "requested_at" else c for c in RECENT_COLUMNS]
    latest_calls = newest.agg(entries("recent", newest_first, *shown)).scalar()
    counted = ("total", "errors", "cancelled", "error_rate", "throughput_rpm", "tokens")
    empty = F.struct(*[F.lit(0 if c in counted else None).cast("bigint").alias(c) for c in kpis])
    whole = parts.select(
        F.lit(minutes).alias("window_minutes"),
        F.coalesce(F.get("summary", F.lit(0)), empty).alias("summary"),
        "series",
        "providers",
        latest_calls.alias("recent"),
    )
    return whole.select(F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false"}).alias("document"))
