"""Minutes and trailing windows as state of a stream.

The ingest job feeds the counts of its new rows per (minute, latency), one file a batch. Minutes lie in blocks of an hour, each
the state of one key, with the last minutes of the hour before beside them, so that every window that ends in the hour can
be told from the block alone. A row is thus held once or twice and not once per window, and hours spread over tasks.

A minute that the watermark has passed is final: its block goes once the whole hour is. What comes later is not lost but
reported as late, and minutes and windows with late rows are answered from the counts the ingest job keeps, which have all
rows (:func:`minutes`, :func:`windows`). A feed file that is written again by a replayed batch counts once: blocks remember
the last batch they took in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from callgauge.functions.numbers import MAX_MINUTES, round_half_up
from callgauge.operators import metrics
from callgauge.session import prepare
from callgauge.streaming import sink as files

#: Minutes in a block, and in a trailing window, which moves by one minute.
BLOCK, WINDOW = 60, 15
MINUTE_MS = 60_000
FEED = "bucket TIMESTAMP, latency_ms INT, calls BIGINT, errors BIGINT, batch_id BIGINT"
OUT = "kind STRING, minute BIGINT, requests BIGINT, errors BIGINT, p50 DOUBLE, p95 DOUBLE"
STATED = {"p50": 0.5, "p95": 0.95}


def feed(histogram: DataFrame, batch_id: int, path: str) -> None:
    """Hands a batch's counts per (bucket, latency_ms) on, in one file, so that they are seen together or not at all."""
    counts = histogram.groupBy("bucket", "latency_ms").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
    files.write_batch(counts.coalesce(1), batch_id, path)


class Pane:
    """Counts of a minute: calls by latency, and all calls and errors, those without a latency too."""

    def __init__(self, latency: bytes = b"", calls: bytes = b"", requests: int = 0, errors: int = 0):
        self.by_latency = dict(zip(np.frombuffer(latency, np.int64).tolist(), np.frombuffer(calls, np.int64).tolist()))
        self.requests, self.errors = requests, errors

    def add(self, rows: pd.DataFrame) -> None:
        timed = rows[rows["latency_ms"].notna()]
        for latency, calls in zip(timed["latency_ms"].astype(np.int64).tolist(), timed["calls"].tolist()):
            self.by_latency[latency] = self.by_latency.get(latency, 0) + calls
        self.requests += int(rows["calls"].sum())
        self.errors += int(rows["errors"].sum())

    def value(self) -> tuple:
        numbers = (np.array(list(x), np.int64).tobytes() for x in (self.by_latency, self.by_latency.values()))
        return (*numbers, self.requests, self.errors)


def told(kind: str, minute: int, panes: list[Pane]) -> tuple:
    """A row of OUT for the minutes of ``panes`` together; percentiles are interpolated and exact."""
    latency = np.array([x for p in panes for x in p.by_latency], np.int64)
    calls = np.array([c for p in panes for c in p.by_latency.values()], np.int64)
    order = np.argsort(latency)
    latency, upto = latency[order], np.cumsum(calls[order])
    found = []
    for q in STATED.values():
        if not len(latency):
            found.append(None)
            continue
        place = (int(upto[-1]) - 1) * q
        low, high = (float(latency[np.searchsorted(upto, k, "right")]) for k in (int(place), int(np.ceil(place))))
        found.append(low + (high - low) * (place - int(place)))
    return (kind, minute, sum(p.requests for p in panes), sum(p.errors for p in panes), *found)


class Panes(StatefulProcessor):
    """One block: its minutes, those before that its windows reach, and the last batch taken in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "minute long", "latency binary, calls binary, requests long, errors long")
        self.applied = handle.getValueState("applied", "batch long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        block, watermark = key[0], timerValues.getCurrentWatermarkInMs()
        done = self.applied.get()[0] if self.applied.exists() else -1
        # two attempts of a batch have the same rows
        new = pd.concat(list(rows)).drop_duplicates(["batch_id", "minute", "latency_ms"])
        new = new[new["batch_id"] > done]
        if new.empty:
            return
        self.applied.update((int(new["batch_id"].max()),))
        passed = (new["minute"] + 1) * MINUTE_MS <= watermark
        late, new = new[passed & (new["minute"] // BLOCK == block)], new[~passed]
        out = [("late", int(m), int(r["calls"].sum()), int(r["errors"].sum()), None, None) for m, r in late.groupby("minute")]
        if not new.empty:
            held = {k[0]: Pane(*v) for k, v in self.panes.iterator()}
            for minute, counts in new.groupby("minute"):
                held.setdefault(minute, Pane()).add(counts)
                self.panes.updateValue((int(minute),), held[minute].value())
            changed = new["minute"].unique().tolist()
            first = block * BLOCK
            out += [("minute", *told("", m, [held[m]])[1:]) for m in changed if m >= first]
            ends = sorted({e for m in changed for e in range(max(m, first), min(m + WINDOW, first + BLOCK))})
            out += [told("window", e, [held[m] for m in range(e - WINDOW + 1, e + 1) if m in held]) for e in ends]
            # a timer for the same time again is the same timer
            self.handle.registerTimer((first + BLOCK) * MINUTE_MS)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing of the hour can change any more. The number of the last batch stays, so that none counts twice."""
        self.panes.clear()
        return iter(())

    def close(self) -> None:
        pass


def start(spark: SparkSession, path: str, sink: str, checkpoint: str, late_by: int = MAX_MINUTES, trigger: dict | None = None) -> StreamingQuery:
    """Keeps minutes and windows of a feed. Every micro-batch writes those it changed, and what came over ``late_by``
    minutes after the newest minute seen before."""
    prepare(spark)
    counts = spark.readStream.schema(FEED).option("ignoreMissingFiles", "true").parquet(path)
    minute = F.floor(F.unix_millis("bucket") / MINUTE_MS)
    blocks = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.floor((minute + k) / BLOCK)))
    # the time column is left out here: the state is to see late rows, which Spark would drop
    rows = counts.withWatermark("bucket", f"{late_by} minutes").select(
        F.explode(blocks).alias("block"), minute.alias("minute"), "latency_ms", "calls", "errors", "batch_id"
    )
    changes = rows.groupBy("block").transformWithStateInPandas(Panes(), OUT, "update", "eventtime")
    return (
        changes.writeStream.outputMode("update")
        .foreachBatch(lambda df, n: files.write_batch(df, n, sink, "kind"))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _told(spark: SparkSession, sink: str) -> DataFrame:
    return files.read(spark, sink, f"{OUT}, batch_id BIGINT")


def late(spark: SparkSession, sink: str) -> DataFrame:
    """Calls that came too late for the state, by minute."""
    rows = _told(spark, sink).where("kind = 'late'").groupBy("minute").agg(F.sum("requests").alias("late"))
    return rows.select(_time("minute").alias("bucket"), "late")


def _time(minute: str) -> F.Column:
    return F.timestamp_millis(F.col(minute) * MINUTE_MS)


def _current(spark: SparkSession, sink: str, kind: str) -> DataFrame:
    rows = files.newest(_told(spark, sink).where(F.col("kind") == kind).drop("kind"), "minute")
    return rows.select(
        _time("minute").alias("bucket"), "requests", "errors", *[round_half_up(F.col(p)).alias(p) for p in STATED]
    )


def minutes(spark: SparkSession, sink: str, kept: DataFrame) -> DataFrame:
    """Requests, errors, p50 and p95 of each minute: out of the state, and where rows were late out of ``kept``, the counts
    of the ingest job."""
    touched = late(spark, sink).select("bucket")
    return _put_together(spark, sink, "minute", touched, kept.join(touched, "bucket", "left_semi"))


def windows(spark: SparkSession, sink: str, kept: DataFrame) -> DataFrame:
    """The same for each window of ``WINDOW`` minutes with calls in it, by its last minute."""
    touched = _spread(late(spark, sink).select("bucket")).distinct()
    # only the minutes of those windows are read from the counts and counted once per window
    recounted = _spread(kept).join(touched, "bucket", "left_semi")
    return _put_together(spark, sink, "window", touched, recounted)


def _spread(rows: DataFrame) -> DataFrame:
    """Every row once for each window its minute is in, under the window's last minute."""
    ends = F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.timestamp_add("MINUTE", k, F.col("bucket")))
    return rows.withColumn("bucket", F.explode(ends))


def _put_together(spark: SparkSession, sink: str, kind: str, touched: DataFrame, counts: DataFrame) -> DataFrame:
    again = metrics.from_histogram(counts, "bucket")
    again = again.select("bucket", F.col("total").alias("requests"), "errors", *[F.col(f"{p}_ms").alias(p) for p in STATED])
    return _current(spark, sink, kind).join(touched, "bucket", "left_anti").unionByName(again)
