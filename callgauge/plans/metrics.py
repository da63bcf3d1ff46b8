"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.functions.numbers import clamp_minutes_col, compact_number, round_half_up
from callgauge.operators import access, cost, metrics, sketch
from callgauge.plans.sql_views import statement
from callgauge.session import scratch_dir
from callgauge.sources import views
from callgauge.sources.tables import table
from callgauge.sources.views import logs

DAY = 1440


def _kpis(*columns: str):
    """Some columns of the whole table's KPI row, per day, each day being a window of 1440 minutes."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return metrics.summary(logs(spark, folder), DAY, "requested_date").select("requested_date", *columns)

    return run


def clamp_minutes(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.expr(
        """case when event_id % 10 = 3 then element_at(array('100d', '90f', ' ', ' 30 ', '1e2', '+.5e3', 'NaN', '-7'), cast(event_id % 8 + 1 as int))
           when event_type = 'view' then null when event_type = 'signup' then 'abc' else cast(value * 20 as string) end"""
    )
    return table(spark, folder, "events").select("event_id", clamp_minutes_col(raw).alias("minutes"))


def time_window(spark: SparkSession, folder: str) -> DataFrame:
    every = logs(spark, folder)
    return metrics.in_window(every, metrics.latest(every), DAY).select("request_id", "requested_at")


def round_nullable(spark: SparkSession, folder: str) -> DataFrame:
    value = F.expr("case when event_type <> 'view' then value / 2 end")
    return table(spark, folder, "events").select("event_id", round_half_up(value).alias("rounded"))


def scan_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The last day of a table stored by date: the bound on the partition column selects its folders."""
    every = logs(spark, folder)
    path = scratch_dir(spark, "scan_logs")
    every.write.partitionBy("requested_date").parquet(path)
    stored = spark.read.schema(every.schema).parquet(path)
    return metrics.in_window(stored, metrics.latest(every), DAY).select("request_id", "requested_at", "requested_date", "status")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.summary(logs(spark, folder), DAY)


def summary_window(spark: SparkSession, folder: str) -> DataFrame:
    every = logs(spark, folder)
    return metrics.summary(metrics.in_window(every, metrics.latest(every), DAY), DAY)


def series_minute(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.series(logs(spark, folder))


def series_hour(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.series(logs(spark, folder), "hour")


def by_provider_model(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.by_provider_model(logs(spark, folder))


def recent_30(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.recent(logs(spark, folder))


def dashboard(spark: SparkSession, folder: str) -> DataFrame:
    """The four parts of one window, one under another."""
    every = logs(spark, folder)
    parts = metrics.dashboard(every, metrics.latest(every), DAY)
    whole = parts["overview"].selectExpr(
        "part",
        """case part when 'summary' then '' when 'series' then date_format(bucket, 'yyyy-MM-dd HH:mm')
           else concat(provider, '/', model) end as label""",
        "total as n",
        "errors",
        "case part when 'providers' then p50_ms else p95_ms end as ms",
    )
    newest = parts["recent"].selectExpr(
        "'recent'", "request_id", "cast(total_tokens as bigint)", "cast(status = 'error' as bigint)", "cast(latency_ms as bigint)"
    )
    return whole.union(newest)


def metrics_document(spark: SparkSession, folder: str) -> DataFrame:
    every = logs(spark, folder)
    return metrics.document(every, metrics.latest(every), DAY)


def window_presets(spark: SparkSession, folder: str) -> DataFrame:
    every = logs(spark, folder)
    return metrics.by_preset(every, metrics.latest(every))


def _sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches by minute, stored and read back as a second job would."""
    path = scratch_dir(spark, "sketches")
    sketch.store(sketch.of_logs(metrics.bucketed(logs(spark, folder)), "bucket"), path)
    return sketch.stored(spark, path)


def latency_sketch(spark: SparkSession, folder: str) -> DataFrame:
    found = sketch.quantiles(_sketches(spark, folder), "bucket")
    return found.select("bucket", F.col("total").alias("requests"), "errors", "p50_ms", "p95_ms", "p99_ms")


def latency_sketch_presets(spark: SparkSession, folder: str) -> DataFrame:
    found = sketch.by_preset(_sketches(spark, folder), metrics.latest(logs(spark, folder)))
    return found.select("preset", "minutes", "total", "errors", "p50_ms", "p95_ms", "p99_ms")


def error_tone(spark: SparkSession, folder: str) -> DataFrame:
    rated = metrics.summary(logs(spark, folder), DAY, "requested_date", "provider", "model")
    return metrics.tone(rated).select("requested_date", "provider", "model", "errors", "total", "tone")


def feed_text(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.feed(logs(spark, folder)).select("request_id", "feed_text")


def compact_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return logs(spark, folder).select("request_id", compact_number(F.col("total_tokens") * 50).alias("shown"))


def minute_label(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.labelled(metrics.series(logs(spark, folder))).select("bucket", "label", "requests")


#: Milliseconds by which logs are late in ``ingest_lag_late``.
_LATE = "case coalesce(total_tokens, 0) % 4 when 1 then 70123 when 2 then 90061234 when 3 then -75321 else 0 end"


def ingest_lag(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.ingest_lag(logs(spark, folder))


def ingest_lag_late(spark: SparkSession, folder: str) -> DataFrame:
    """The same with logs stored over a minute or a day late, or early, by turns."""
    late = F.expr(f"timestamp_millis(unix_millis(cast(ingested_at as timestamp)) + {_LATE})")
    return metrics.ingest_lag(logs(spark, folder).withColumn("ingested_at", late))


def logs_by_time(spark: SparkSession, folder: str) -> DataFrame:
    every = logs(spark, folder)
    return access.by_time(every, metrics.latest(every), DAY).select("request_id", "requested_at", "status")


def logs_by_provider_model(spark: SparkSession, folder: str) -> DataFrame:
    return access.of_provider_model(logs(spark, folder), "openai", "large").select("request_id", "requested_at")


def logs_of_conversation(spark: SparkSession, folder: str) -> DataFrame:
    return access.of_conversation(logs(spark, folder), 7).select("request_id", "conversation_id", "requested_at")


def error_logs(spark: SparkSession, folder: str) -> DataFrame:
    return access.errors(logs(spark, folder)).select("request_id", "error_type", "requested_at")


def call_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Every call with the price valid at its time."""
    costed = cost.with_cost(views.priced_calls(spark, folder), views.prices(spark, folder))
    return costed.select("request_id", "price.valid_from", F.col("cost_pico").cast("bigint").alias("cost_pico"))


def cost_by_model(spark: SparkSession, folder: str) -> DataFrame:
    costed = cost.with_cost(views.priced_calls(spark, folder), views.prices(spark, folder))
    return cost.spend(costed, "provider", "model").withColumn("cost_pico", F.col("cost_pico").cast("bigint"))


def metadata_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return access.with_metadata(logs(spark, folder), "$.k", 42, "int").select("request_id", "metadata")


QUERIES = {
    "clamp_minutes": clamp_minutes,
    "time_window": time_window,
    "scan_logs": scan_logs,
    "kpi_total": _kpis("total"),
    "kpi_errors": _kpis("errors", "cancelled"),
    "kpi_tokens": _kpis("tokens"),
    "kpi_latency_pct": _kpis("p50_ms", "p95_ms", "p99_ms"),
    "kpi_ttft": _kpis("avg_ttft_ms"),
    "kpi_error_rate": _kpis("error_rate"),
    "kpi_throughput": _kpis("throughput_rpm"),
    "round_nullable": round_nullable,
    "summary": summary,
    "summary_window": summary_window,
    "series_minute": series_minute,
    "series_hour": series_hour,
    "by_provider_model": by_provider_model,
    "recent_30": recent_30,
    "dashboard": dashboard,
    "metrics_document": metrics_document,
    "window_presets": window_presets,
    "latency_sketch": latency_sketch,
    "latency_sketch_presets": latency_sketch_presets,
    "error_tone": error_tone,
    "feed_text": feed_text,
    "compact_number": compact_numbers,
    "minute_label": minute_label,
    "ingest_lag": ingest_lag,
    "ingest_lag_late": ingest_lag_late,
    "logs_by_time": logs_by_time,
    "logs_by_provider_model": logs_by_provider_model,
    "logs_of_conversation": logs_of_conversation,
    "error_logs": error_logs,
    "metadata_lookup": metadata_lookup,
    "call_cost": call_cost,
    "cost_by_model": cost_by_model,
}


#: The middle of a latency's slot: 128 slots for each power of two from 256 on.
_SLOT = """case when latency_ms < 256 then latency_ms::bigint else
    ((latency_ms::bigint >> (length(bin(latency_ms::bigint)) - 8)) << (length(bin(latency_ms::bigint)) - 8))
    + (1::bigint << (length(bin(latency_ms::bigint)) - 9)) end"""


def rounded(expression: str) -> str:
    return f"cast(floor(round({expression}, 6) + 0.5) as bigint)"


_SKETCHED = ", ".join(
    f"{rounded(f'percentile_cont({p}) within group (order by {_SLOT})')} as {name}_ms" for name, p in metrics.PERCENTILES.items()
)


def _pct(p: float) -> str:
    return rounded(f"percentile_cont({p}) within group (order by latency_ms)")


LAST_DAY = "requested_at >= (select max(requested_at) from logs) - interval '1440' minute"
KPI = {
    "total": "count(*)",
    "errors": "count(*) filter (where status = 'error')",
    "cancelled": "count(*) filter (where status = 'cancelled')",
    "tokens": "cast(coalesce(sum(total_tokens), 0) as bigint)",
    "p50_ms": _pct(0.5),
    "p95_ms": _pct(0.95),
    "p99_ms": _pct(0.99),
    "avg_ttft_ms": rounded("avg(ttft_ms) filter (where streaming)"),
    "error_rate": "case when count(*) > 0 then count(*) filter (where status = 'error') / cast(count(*) as double) else 0.0 end",
    "throughput_rpm": "count(*) / cast(1440 as double)",
}
KPI_ROW = ", ".join(f"{sql} as {name}" for name, sql in KPI.items())


def _daily(*names: str) -> str:
    columns = ", ".join(f"{KPI[n]} as {n}" for n in names)
    return statement(f"select requested_date, {columns} from logs group by requested_date")


def _series(unit: str, extra: str = "") -> str:
    return (
        f"select date_trunc('{unit}', requested_at) as bucket, count(*) as requests, {KPI['errors']} as errors, "
        f"{_pct(0.95)} as p95 from logs {extra} group by 1"
    )


PROVIDERS = (
    f"select provider, model, count(*) as requests, {KPI['errors']} as errors, {_pct(0.5)} as p50_ms, "
    f"{KPI['tokens']} as tokens from logs"
)
RECENT = ", ".join(metrics.RECENT_COLUMNS)
NEWEST = "order by requested_at desc, request_id limit 30"
STAMP = "'%Y-%m-%dT%H:%M:%S.%gZ'"

COST = {
    "prices": """select provider, model, requested_at as valid_from, 100000 + event_id * 7 as prompt_price, 300000 + event_id as completion_price
          from logs where event_id % 10 in (5, 8)
        union all select provider, model, requested_at + interval '20' second, 90000 + event_id * 3, 250000 + event_id
          from logs where event_id % 10 in (5, 8)""",
    "priced": """select *, case when event_id % 17 = 0 then 'other' else provider end as asked, total_tokens // 3 as prompt_tokens,
        total_tokens - total_tokens // 3 as completion_tokens from logs""",
    "costed": """select l.request_id, l.asked as provider, l.model, p.valid_from,
          coalesce(prompt_tokens, 0) * prompt_price + coalesce(completion_tokens, 0) * completion_price as cost_pico
        from priced l asof left join prices p on l.asked = p.provider and l.model = p.model and l.requested_at >= p.valid_from""",
}

ORACLE = {
    # what a number is follows the request's language: no suffixes, blanks count as 0
    "clamp_minutes": """select event_id, case when event_id % 10 = 3 then ([5.0, 5.0, 5.0, 30.0, 100.0, 500.0, 5.0, 5.0])[event_id % 8 + 1]
        when event_type = 'view' then 60.0 when event_type = 'signup' then 5.0
        else greatest(5.0, least(1440.0, value * 20)) end as minutes from events""",
    "time_window": statement(f"select request_id, requested_at from logs where {LAST_DAY}"),
    "scan_logs": statement(f"select request_id, requested_at, requested_date, status from logs where {LAST_DAY}"),
    "kpi_total": _daily("total"),
    "kpi_errors": _daily("errors", "cancelled"),
    "kpi_tokens": _daily("tokens"),
    "kpi_latency_pct": _daily("p50_ms", "p95_ms", "p99_ms"),
    "kpi_ttft": _daily("avg_ttft_ms"),
    "kpi_error_rate": _daily("error_rate"),
    "kpi_throughput": _daily("throughput_rpm"),
    "round_nullable": f"select event_id, case when event_type <> 'view' then {rounded('value / 2')} end as rounded from events",
    "summary": statement(f"select {KPI_ROW} from logs"),
    "summary_window": statement(f"select {KPI_ROW} from logs where {LAST_DAY}"),
    "series_minute": statement(_series("minute")),
    "series_hour": statement(_series("hour")),
    "by_provider_model": statement(f"{PROVIDERS} group by provider, model"),
    "recent_30": statement(f"select {RECENT} from logs {NEWEST}"),
    "dashboard": statement(f"""
        select 'summary' as part, '' as label, count(*) as n, {KPI['errors']} as errors, {_pct(0.95)} as ms from logs where {LAST_DAY}
        union all select 'series', strftime(date_trunc('minute', requested_at), '%Y-%m-%d %H:%M'), count(*), {KPI['errors']}, {_pct(0.95)}
         from logs where {LAST_DAY} group by 1, 2
        union all select 'providers', provider || '/' || model, count(*), {KPI['errors']}, {_pct(0.5)}
         from logs where {LAST_DAY} group by provider, model
        union all select 'recent', request_id, total_tokens, cast(status = 'error' as bigint), latency_ms
         from (select * from logs where {LAST_DAY} {NEWEST}) r"""),
    "metrics_document": statement(f"""
        select to_json({{'window_minutes': 1440,
          'summary': (select {{{', '.join(f"'{n}': {n}" for n in ('total', 'errors', 'cancelled', 'error_rate', 'throughput_rpm', 'tokens', 'p50_ms', 'p95_ms', 'p99_ms', 'avg_ttft_ms'))}}}
             from (select {KPI_ROW} from logs where {LAST_DAY}) s),
          'series': (select list({{'t': strftime(bucket, {STAMP}), 'requests': requests, 'errors': errors, 'p95': p95}} order by bucket)
             from ({_series('minute', 'where ' + LAST_DAY)}) s),
          'providers': (select list({{'provider': provider, 'model': model, 'requests': requests, 'errors': errors, 'p50_ms': p50_ms, 'tokens': tokens}}
             order by requests desc, provider, model) from ({PROVIDERS} where {LAST_DAY} group by provider, model) p),
          'recent': (select list({{{', '.join(f"'{c}': " + (f'strftime({c}, {STAMP})' if c == 'requested_at' else c) for c in metrics.RECENT_COLUMNS)}}}
             order by requested_at desc, request_id) from (select * from logs where {LAST_DAY} {NEWEST}) r)
        }})::varchar as document"""),
    "window_presets": statement(
        " union all ".join(
            f"select '{name}' as preset, {m} as minutes, {KPI_ROW.replace('cast(1440 as double)', f'cast({m} as double)')} from logs "
            f"where requested_at >= (select max(requested_at) from logs) - interval '{m}' minute"
            for name, m in metrics.WINDOW_PRESETS.items()
        )
    ),
    "latency_sketch": statement(
        f"select date_trunc('minute', requested_at) as bucket, count(*) as requests, {KPI['errors']} as errors, {_SKETCHED} from logs group by 1"
    ),
    "latency_sketch_presets": statement(
        " union all ".join(
            f"select '{name}' as preset, {m} as minutes, count(*) as total, {KPI['errors']} as errors, {_SKETCHED} from logs "
            f"where requested_at >= (select date_trunc('minute', max(requested_at)) from logs) - interval '{m}' minute"
            for name, m in metrics.WINDOW_PRESETS.items()
        )
    ),
    "error_tone": statement(f"""select requested_date, provider, model, {KPI['errors']} as errors, count(*) as total,
        case when {KPI['error_rate']} > 0.1 then 'alert' else 'ok' end as tone from logs group by requested_date, provider, model"""),
    "feed_text": statement("""select request_id,
        coalesce(nullif(output_preview, ''), nullif(error_type, ''), nullif(input_preview, ''), '') as feed_text from logs"""),
    # a binary value that is a half itself goes up, all others as their digits say; printf knows the digits
    "compact_number": statement("""select request_id, case when total_tokens * 50 < 1000 then cast(total_tokens * 50 as varchar)
        when total_tokens * 50 % 500 = 250 then printf('%.1fk', (total_tokens * 50 + 10) / 1000.0::double)
        else printf('%.1fk', total_tokens * 50 / 1000.0::double) end as shown from logs"""),
    "minute_label": statement("""select date_trunc('minute', requested_at) as bucket,
        strftime(date_trunc('minute', requested_at), '%H:%M') as label, count(*) as requests from logs group by 1, 2"""),
    "ingest_lag": statement(f"""select date_trunc('minute', requested_at) as bucket, count(*) as calls,
        {rounded("percentile_cont(0.5) within group (order by lag)")} as p50_lag_ms,
        {rounded("percentile_cont(0.95) within group (order by lag)")} as p95_lag_ms, max(lag) as max_lag_ms
        from (select requested_at, epoch_ms(ingested_at) - epoch_ms(requested_at) as lag from logs) l group by 1"""),
    # whole seconds from a minute on, whole minutes from a day on, towards zero; the worst lag is exact
    "ingest_lag_late": statement(f"""select date_trunc('minute', requested_at) as bucket, count(*) as calls,
        {rounded("percentile_cont(0.5) within group (order by shown)")} as p50_lag_ms,
        {rounded("percentile_cont(0.95) within group (order by shown)")} as p95_lag_ms, max(lag) as max_lag_ms
        from (select *, case when abs(lag) < 60000 then lag when abs(lag) < 86400000 then sign(lag) * (abs(lag) // 1000) * 1000
            else sign(lag) * (abs(lag) // 60000) * 60000 end as shown
            from (select requested_at, epoch_ms(ingested_at) - epoch_ms(requested_at) + {_LATE} as lag from logs) a) l
        group by 1"""),
    "logs_by_time": statement(f"select request_id, requested_at, status from logs where {LAST_DAY}"),
    "logs_by_provider_model": statement(
        "select request_id, requested_at from logs where provider = 'openai' and model = 'large'"
    ),
    "logs_of_conversation": statement(
        "select request_id, conversation_id, requested_at from logs where conversation_id = 7"
    ),
    "error_logs": statement("select request_id, error_type, requested_at from logs where status = 'error'"),
    "call_cost": statement("select request_id, valid_from, cost_pico from costed", **COST),
    "cost_by_model": statement(
        """select provider, model, count(*) as requests, count(*) filter (where cost_pico is null) as unpriced,
          cast(coalesce(sum(cost_pico), 0) as bigint) as cost_pico from costed group by provider, model""",
        **COST,
    ),
    "metadata_lookup": statement(
        "select request_id, metadata from logs where cast(json_extract_string(metadata, '$.k') as int) = 42"
    ),
}
