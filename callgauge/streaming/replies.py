"""Replies put together while their chunks still come in.

The state of a call is the lines seen so far, one entry per call and micro-batch, and the numbers of them. Lines are numbered
from zero without gaps and may come in any order, more than once, and spread over batches. A call goes out once: ``complete``
when the end marker and all lines before it are there, or ``unfinished`` with what there is when the watermark has passed its
newest line by ``timeout``. Then only its numbers stay, until the watermark is ``keep`` further, so copies change nothing.
Lines of an unfinished call that come after that go out under ``late``, as do lines that are so old that their call may have
been forgotten (these may be copies); nothing is dropped unseen.

The lines of the calls that go out pass through the batch operator (:func:`callgauge.operators.chunks.reassemble`), so texts,
finish reasons and usage are just as there. Every micro-batch owns a folder; one that is replayed starts from the same state
and replaces it. A long call is held in the state store and handed on batch by batch; in memory are 8 bytes a line.

Lines without a call, a number or an arrival are dropped; null data is an empty line. Other columns are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from callgauge.operators import chunks
from callgauge.session import prepare
from callgauge.streaming import sink as files

OUTCOMES = ("complete", "unfinished", "late")
LINES = "call_id {key}, outcome STRING, seq BIGINT, data STRING"
MINUTE_MS = 60_000


def _is_end(dialect: str, data: str) -> bool:
    if dialect == "completions":
        return data == chunks.DONE
    if "message_stop" not in data:
        return False
    try:
        value = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(value, dict) and value.get("type") == "message_stop"


class Replies(StatefulProcessor):
    """One call."""

    def __init__(self, dialect: str, timeout_ms: int, keep_ms: int):
        self.dialect, self.timeout, self.keep = dialect, timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.info = handle.getValueState("info", "seqs binary, ending long, newest long, parts long, outcome string")
        self.lines = handle.getMapState("lines", "part long", "lines string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, known = timerValues.getCurrentWatermarkInMs(), self.info.exists()
        held, ending, newest, parts, outcome = self.info.get() if known else (b"", -1, -1, 0, "")
        seqs, fresh = np.frombuffer(held, np.int64), False
        if outcome == "complete":
            return
        for frame in rows:
            frame = frame.drop_duplicates("seq")
            frame = frame[~np.isin(frame["seq"].to_numpy(np.int64), seqs)]
            old = frame["at"] <= watermark - self.keep if not known and not fresh else pd.Series(False, frame.index)
            if outcome or old.any():
                gone = frame if outcome else frame[old]
                yield self._out(key, "late", gone["seq"].tolist(), gone["data"].tolist())
                frame = frame[~old]
            if not len(frame):
                continue
            fresh = True
            numbers, data = frame["seq"].tolist(), frame["data"].tolist()
            seqs = np.union1d(seqs, np.array(numbers, np.int64))
            newest = max(newest, int(frame["at"].max()))
            if not outcome:
                self.lines.updateValue((parts,), (json.dumps([numbers, data]),))
                parts += 1
                ends = [n for n, d in zip(numbers, data) if _is_end(self.dialect, d)]
                ending = min([e for e in (ending, *ends) if e >= 0], default=-1)
        if not fresh:
            return
        # without an outcome: are all lines up to the marker there?
        if not outcome and ending >= 0 and np.searchsorted(seqs, ending, "right") - np.searchsorted(seqs, 0) == ending + 1:
            outcome, seqs = "complete", seqs[:0]
            yield from self._all(key, outcome)
        self.info.update((seqs.tobytes(), ending, newest, parts, outcome))
        self.handle.registerTimer(newest + self.timeout + (self.keep if outcome else 0))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.info.exists():
            return
        seqs, ending, newest, parts, outcome = self.info.get()
        # a timer from before a newer line has another one behind it
        due = expiredTimerInfo.getExpiryTimeInMs() - newest - self.timeout
        if outcome:
            if due >= self.keep:
                self.info.clear()
        elif due >= 0:
            yield from self._all(key, "unfinished")
            self.info.update((seqs, ending, newest, parts, "unfinished"))
            self.handle.registerTimer(newest + self.timeout + self.keep)

    def _all(self, key, outcome: str) -> Iterator[pd.DataFrame]:
        for _, (lines,) in self.lines.iterator():
            yield self._out(key, outcome, *json.loads(lines))
        self.lines.clear()

    def _out(self, key, outcome: str, numbers: list, data: list) -> pd.DataFrame:
        return pd.DataFrame({"call_id": [key[0]] * len(data), "outcome": outcome, "seq": numbers, "data": data})

    def close(self) -> None:
        pass


def start(
    lines: DataFrame,
    dialect: str,
    sink: str,
    checkpoint: str,
    timeout: int = 30,
    late_by: int = 5,
    keep: int = 1_440,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Stores the replies of a stream of lines (``call_id``, ``seq``, ``data``, ``arrived_at``); all times in minutes.

    ``late_by`` is how far lines may be out of order between batches without moving the watermark past each other.
    """
    if dialect not in chunks.DIALECTS:
        raise ValueError(f"dialect must be one of {tuple(chunks.DIALECTS)}")
    prepare(lines.sparkSession)
    kind = lines.schema["call_id"].dataType.simpleString()
    # the time column is left out: the state is to see late lines, which Spark would drop
    rows = (
        lines.where("call_id is not null and seq is not null and arrived_at is not null")
        .withWatermark("arrived_at", f"{late_by} minutes")
        .select(
            "call_id",
            F.col("seq").cast("bigint").alias("seq"),
            F.coalesce("data", F.lit("")).alias("data"),
            F.unix_millis("arrived_at").alias("at"),
        )
    )
    processor = Replies(dialect, timeout * MINUTE_MS, keep * MINUTE_MS)
    out = rows.groupBy("call_id").transformWithStateInPandas(processor, LINES.format(key=kind), "append", "eventtime")

    def write(done: DataFrame, batch_id: int) -> None:
        one = done.select(F.struct("call_id", "outcome").alias("call_id"), "seq", "data")
        whole = chunks.reassemble(one, dialect)
        files.write_batch(whole.select("call_id.*", *[c for c in whole.columns if c != "call_id"]), batch_id, sink)

    return (
        out.writeStream.outputMode("append")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored(spark: SparkSession, sink: str) -> DataFrame:
    """A row per call, and per batch one more for a call with late lines."""
    return files.read(spark, sink).drop(files.BATCH)
