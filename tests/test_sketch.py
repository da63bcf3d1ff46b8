"""Latency sketches: bounded size, stated error, merging in any order."""

import math
import random

from pyspark.sql import functions as F

from callgauge.operators import metrics, sketch
from callgauge.sources.views import logs

LOGS = "bucket string, status string, streaming boolean, ttft_ms bigint, total_tokens bigint, latency_ms bigint"


def rows(latencies, buckets=3):
    return [(f"b{i % buckets}", "error" if i % 7 == 0 else "success", i % 2 == 0, i, i % 5, v) for i, v in enumerate(latencies)]


def spread(n=6000, seed=3):
    draw = random.Random(seed)
    return [draw.choice([draw.randrange(300), int(draw.lognormvariate(8, 3)), draw.randrange(2**40, 2**41)]) for _ in range(n)]


def close(found, exact):
    """Within the stated error of the exact value, and half a millisecond of rounding on either side."""
    return abs(found - exact) <= sketch.ERROR * abs(exact) + 1


def test_every_slot_holds_its_middle(spark):
    values = [0, 1, 255, 256, 257, 258, 511, 512, 515, 516, 2**31, 2**62, 2**63 - 1, -1, -300, None]
    values += [2**k + d for k in range(9, 60, 7) for d in (-1, 0, 1, 2**k // 3)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", sketch.middle("v").alias("m"))
    for v, m, again in df.select("*", sketch.middle("m")).collect():
        assert m == again and (m is None) == (v is None)
        if v is not None:
            assert abs(m - v) <= sketch.ERROR * abs(v) and (abs(v) >= 256 or m == v)


def test_error_and_size_against_exact(spark):
    """Latencies of any size: the groups' quantiles are within the error, the totals equal, the rows bounded."""
    df = spark.createDataFrame(rows(spread()), LOGS)
    held = sketch.of_logs(df, "bucket")
    got = {r.bucket: r for r in sketch.quantiles(held, "bucket").collect()}
    for want in metrics.from_histogram(metrics.latency_histogram(df, "bucket"), "bucket").collect():
        have = got[want.bucket]
        assert [have[c] for c in ("total", "errors", "cancelled", "tokens", "avg_ttft_ms")] == [
            want[c] for c in ("total", "errors", "cancelled", "tokens", "avg_ttft_ms")
        ]
        assert all(close(have[c], want[c]) for c in ("p50_ms", "p95_ms", "p99_ms"))
    all_of_them = spark.range(1_000_000).select(
        F.lit("b").alias("bucket"), F.lit("success").alias("status"), F.lit(False).alias("streaming"), F.lit(0).alias("ttft_ms"),
        F.lit(1).alias("total_tokens"), (F.col("id") * 1_000_003).alias("latency_ms"),
    )
    size = sketch.of_logs(all_of_them, "bucket").count()
    assert size <= 2**8 + (math.ceil(math.log2(1e12)) - 8) * 2**7 < sketch.SLOTS


def test_merging_in_any_order(spark):
    """Sketches of parts, merged as they come and merged again, are the sketch of the whole."""
    data = rows(spread(900, 4))
    key = lambda df: sorted(tuple(r) for r in df.select("bucket", "latency_ms", *metrics.ADDITIVE).collect())
    whole = key(sketch.of_logs(spark.createDataFrame(data, LOGS), "bucket"))
    parts = [sketch.of_logs(spark.createDataFrame(data[i::3], LOGS), "bucket") for i in range(3)]
    first = sketch.of_histogram(parts[2].unionByName(parts[0]), "bucket")
    assert key(sketch.of_histogram(parts[1].unionByName(first), "bucket")) == whole
    exact = metrics.latency_histogram(spark.createDataFrame(data, LOGS), "bucket")
    assert key(sketch.of_histogram(exact, "bucket")) == whole


def test_every_minute_and_preset_of_the_log(spark, folder, tmp_path):
    """What is stored answers every minute and window within the error; a window reads the folders of its dates."""
    every = metrics.bucketed(logs(spark, folder))
    path = str(tmp_path / "sketches")
    sketch.store(sketch.of_logs(every, "bucket"), path)
    held, names = sketch.stored(spark, path), ("p50_ms", "p95_ms", "p99_ms")
    exact = {r.bucket: r for r in metrics.from_histogram(metrics.latency_histogram(every, "bucket"), "bucket").collect()}
    got = sketch.quantiles(held, "bucket").collect()
    assert len(got) == len(exact) and all(close(r[c], exact[r.bucket][c]) for r in got for c in names)
    as_of = metrics.latest(every)
    presets = sketch.by_preset(held, as_of)
    newest = as_of.replace(second=0, microsecond=0)
    for r in presets.collect():
        want = metrics.summary(metrics.in_window(every, newest, r.minutes), r.minutes).first()
        assert (r.total, r.errors) == (want.total, want.errors) and all(close(r[c], want[c]) for c in names)
    assert "requested_date" in presets._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1][:200]


def test_nulls_and_nothing(spark):
    some = sketch.quantiles(sketch.of_logs(spark.createDataFrame(rows([None, 5, None], 1), LOGS), "bucket"), "bucket").first()
    assert (some.total, some.p50_ms) == (3, 5)
    assert sketch.of_logs(spark.createDataFrame([], LOGS), "bucket").count() == 0
    assert sketch.quantiles(sketch.of_logs(spark.createDataFrame([], LOGS))).first().total == 0
