import json
import random
import time
from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.functions import numbers
from callgauge.functions.text import first_text, strip
from callgauge.operators import metrics
from callgauge.operators.percentiles import percentiles


@pytest.mark.parametrize(
    "raw, minutes",
    [(None, 60), ("abc", 5), ("", 5), ("1", 5), ("7.5", 7.5), ("99999", 1440), (" 15 ", 15), ("1e2", 100), ("Infinity", 5), (float("nan"), 5), (60, 60)],
)
def test_clamp(raw, minutes):
    assert numbers.clamp_minutes(raw) == minutes


def test_clamp_column_agrees(spark):
    raw = [None, "abc", "", "1", "7.5", "99999", "1e2", "Infinity", "NaN", "100d", "90f", "8L", " 15 ", "+20", "-3", ".5e2", "1e999", "0x10", "1_0"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert [r[0] for r in df.select(numbers.clamp_minutes_col(F.col("raw"))).collect()] == [numbers.clamp_minutes(r) for r in raw]


def test_numbers(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert [one(numbers.round_half_up(F.lit(x))) for x in (0.5, 1.4999999999, 2.5, None)] == [1, 2, 3, None]
    assert [one(numbers.compact_number(F.lit(n))) for n in (0, 999, 1000, 12345)] == ["0", "999", "1.0k", "12.3k"]
    # decimal halves by their binary value; only those that are halves in binary, too, always go up
    halves = {1050: "1.1k", 1150: "1.1k", 1250: "1.3k", 1350: "1.4k", 1450: "1.4k", 1750: "1.8k", 999950: "1000.0k"}
    for n in [*halves, *range(1050, 60_000, 100), 2**31 - 98]:
        exact = Decimal(n / 1000)
        down, up = Decimal(n // 100) / 10, Decimal(n // 100 + 1) / 10
        halves[n] = f"{up if up - exact <= exact - down else down:.1f}k" if n % 100 == 50 else f"{exact:.1f}k"
    df = spark.createDataFrame([(n,) for n in halves], "n long").select("n", numbers.compact_number(F.col("n")).alias("s"))
    assert {r.n: r.s for r in df.collect()} == halves
    assert [halves[n] for n in (1050, 1150, 1250, 1450)] == ["1.1k", "1.1k", "1.3k", "1.4k"]
    assert one(numbers.ratio(F.lit(0), F.lit(0))) == 0.0
    assert one(first_text(F.lit(""), F.lit(None), F.lit("x"))) == "x"
    assert one(strip(F.lit("\r\n  a b ﻿\t"))) == "a b"


def test_strip_in_linear_time(spark):
    blanks = " \t\u2003" * 333_333
    df = spark.createDataFrame([("a" + blanks + "b" + blanks,)], "t string").select(strip(F.col("t")).alias("t"))
    df.collect()
    start = time.perf_counter()
    assert df.first().t == "a" + blanks + "b"
    assert time.perf_counter() - start < 2


def test_equal_milliseconds_keep_their_order(spark):
    at = datetime(2024, 1, 1, 12)
    row = ("p", "m", "success", True, 10, 5, 7, False, None, None, None)
    names = "request_id string, provider string, model string, status string, streaming boolean, latency_ms int, ttft_ms int, total_tokens int, pii_redacted boolean, input_preview string, output_preview string, error_type string, requested_at timestamp_ntz"
    logs = spark.createDataFrame([("a", *row, at.replace(microsecond=400)), ("b", *row, at.replace(microsecond=300)), ("c", *row, at.replace(microsecond=500))], names)
    document = json.loads(metrics.document(logs, at, 1_000_000).first().document)
    assert [r["request_id"] for r in document["recent"]] == ["c", "a", "b"]
    assert document["window_minutes"] == 1440
    assert metrics.dashboard(logs, at)["overview"].where("part = 'summary'").first().throughput_rpm == 3 / 60


def test_scan_of_a_table_by_date_selects_folders(spark, folder):
    from callgauge.plans.metrics import scan_logs

    plan = scan_logs(spark, folder)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "requested_date" in filters and ">=" in filters


def test_percentiles_of_few(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (5, 1), (None, 3)], "v int, n long")
    row = percentiles(df, [], "v", "n", {"a": 0.5, "b": 0.95, "c": 0.99}, rows=F.sum("n")).first()
    assert (row.a, round(row.b, 9), round(row.c, 9), row.rows) == (2.0, 4.7, 4.94, 6)
    empty = percentiles(df.where("v > 9"), [], "v", "n", {"a": 0.5}, rows=F.coalesce(F.sum("n"), F.lit(0))).first()
    assert (empty.a, empty.rows) == (None, 0)


def test_percentiles_when_one_group_holds_most_rows(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 20)}", rng.randint(0, 2000) ** 2) for _ in range(20000)]
    df = spark.createDataFrame(data, "g string, v int").groupBy("g", "v").agg(F.count("*").alias("n"))
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r.g: (r.p50, r.p95, r.p99) for r in percentiles(df, ["g"], "v", "n", wanted).collect()}
    for group in {g for g, _ in data}:
        want = np.percentile([v for g, v in data if g == group], [50, 95, 99])
        assert got[group] == pytest.approx(want, rel=1e-12)


LOG = "request_id string, provider string, model string, status string, streaming boolean, latency_ms int, ttft_ms int, total_tokens int, requested_at timestamp_ntz"


def test_empty_window(spark):
    row = metrics.summary(spark.createDataFrame([], LOG), 60).first()
    assert (row.total, row.errors, row.tokens, row.error_rate, row.throughput_rpm, row.p50_ms, row.avg_ttft_ms) == (0, 0, 0, 0.0, 0.0, None, None)


def test_presets_keep_empty_windows_and_the_lower_bound(spark):
    as_of = datetime(2024, 1, 1, 12)
    at = [datetime(2024, 1, 1, 11, 45), datetime(2024, 1, 1, 11, 44, 59), datetime(2024, 1, 1, 13)]
    logs = spark.createDataFrame([(f"r{i}", "p", "m", "success", False, 10, None, 1, t) for i, t in enumerate(at)], LOG)
    assert {r.preset: r.total for r in metrics.by_preset(logs, as_of).collect()} == {"15m": 2, "1h": 3, "6h": 3, "24h": 3}
    none = metrics.by_preset(logs.where("false"), as_of).collect()
    assert {r.preset: (r.total, r.p50_ms) for r in none} == dict.fromkeys(("15m", "1h", "6h", "24h"), (0, None))


def test_parts_add_up(spark, folder):
    from callgauge.sources.views import logs

    every = logs(spark, folder)
    total = metrics.summary(every, 60).first().total
    assert metrics.series(every).agg(F.sum("requests")).first()[0] == total
    assert metrics.by_provider_model(every).agg(F.sum("requests")).first()[0] == total
    parts = {r.part: r.n for r in metrics.overview(every, 60).groupBy("part").agg(F.sum("total").alias("n")).collect()}
    assert parts == dict.fromkeys(("summary", "series", "providers"), total)
