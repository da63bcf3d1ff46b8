import datetime as dt
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callgauge.session import scratch_dir
from callgauge.streaming import panes, sink

FROM = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
COUNTS = "bucket timestamp, latency_ms int, calls long, errors long, cancelled long, tokens long, ttft_sum long, ttft_calls long"


def counts(spark, rows):
    """Minute counts of (minute, latency) calls; an odd latency is an error."""
    grouped = Counter(rows)
    made = [(FROM + dt.timedelta(minutes=m), x, n, n * ((x or 0) % 2), 0, 0, 0, 0) for (m, x), n in grouped.items()]
    return spark.createDataFrame(made, COUNTS)


class Kept:
    def __init__(self, spark):
        self.spark, home = spark, scratch_dir(spark, "panes")
        self.feed, self.sink, self.checkpoint = (f"{home}/{p}" for p in ("feed", "sink", "checkpoint"))
        self.rows = []

    def take(self, batch, rows, run=True):
        panes.feed(counts(self.spark, rows), batch, self.feed)
        if run:
            self.rows += rows
            panes.start(self.spark, self.feed, self.sink, self.checkpoint).awaitTermination()

    def check(self):
        kept = counts(self.spark, self.rows)
        for width, found in ((1, panes.minutes), (panes.WINDOW, panes.windows)):
            got = {tuple(r) for r in found(self.spark, self.sink, kept).select(F.unix_seconds("bucket"), "requests", "errors", "p50", "p95").collect()}
            assert got == plain(self.rows, width)


def plain(rows, width):
    out = {}
    for m, x in rows:
        for end in range(m, m + width):
            out.setdefault(end, []).append(x)
    rounded = lambda xs, q: int(np.floor(round(float(np.percentile(xs, q)), 6) + 0.5)) if xs else None
    return {
        (int(FROM.timestamp()) + 60 * end, len(xs), sum((x or 0) % 2 for x in xs), *(rounded([x for x in xs if x is not None], q) for q in (50, 95)))
        for end, xs in out.items()
    }


def calls(rng, n, low, high):
    return [(rng.randrange(low, high), rng.choice([None, 5, 8, rng.randrange(1000)])) for _ in range(n)]


def test_minutes_and_windows_equal_a_recount_whatever_comes_late(spark):
    rng, kept = random.Random(1), Kept(spark)
    kept.take(0, calls(rng, 300, 2000, 2130))
    kept.check()
    # at the border of hours, then a day and more back, then far ahead
    kept.take(1, calls(rng, 100, 1900, 2000) + calls(rng, 50, 2100, 2200))
    kept.take(2, calls(rng, 80, 0, 100) + calls(rng, 20, 690, 770) + calls(rng, 5, 2119, 2121))
    kept.check()
    late = {r.bucket for r in panes.late(spark, kept.sink).collect()}
    limit = max(m for m, _ in kept.rows[:450]) - 1440
    assert len(late) == len({m for m, _ in kept.rows if m + 1 <= limit}) > 0
    kept.take(3, calls(rng, 10, 9000, 9010))
    kept.take(4, calls(rng, 10, 2000, 2130))
    kept.check()


def test_a_batch_that_is_written_again_counts_once(spark):
    rng, kept = random.Random(2), Kept(spark)
    kept.take(0, first := calls(rng, 50, 100, 200))
    kept.take(0, first, run=False)
    kept.take(1, calls(rng, 50, 100, 200))
    kept.take(1, kept.rows[50:], run=False)
    kept.take(2, [(150, 3)])
    kept.check()


def test_state_is_bounded(spark):
    kept = Kept(spark)
    for batch in range(6):
        kept.take(batch, [(3000 * batch + m, 7) for m in range(0, 120, 7)])
    held = sink.read(spark, kept.sink).where("kind = 'window'").agg(F.max("requests")).first()[0]
    assert held == 3  # 15 minutes hold at most three of them
    state = spark.read.format("statestore").option("stateVarName", "panes").load(kept.checkpoint)
    blocks = {r[0] - int(FROM.timestamp()) // 3600 for r in state.select("key.block").collect()}
    # of 18,120 minutes only those of the last day and the newest hours are held
    assert blocks and blocks <= {b for b in range((15_000 - 1440) // 60, 15_200 // 60)}


@pytest.mark.parametrize("seed", range(5))
def test_percentiles_of_several_panes(seed):
    rng = random.Random(seed)
    values = [[rng.randrange(50) for _ in range(rng.randrange(30))] for _ in range(4)]
    made = []
    for of_minute in values:
        pane = panes.Pane()
        counted = Counter(of_minute)
        pane.add(pd.DataFrame({"latency_ms": list(counted), "calls": list(counted.values()), "errors": [0] * len(counted)}))
        made.append(panes.Pane(*pane.value()))
    flat = sum(values, [])
    _, _, requests, _, p50, p95 = panes.told("window", 0, made)
    assert requests == len(flat)
    assert (p50, p95) == (pytest.approx(np.percentile(flat, 50)), pytest.approx(np.percentile(flat, 95))) if flat else (None, None)
