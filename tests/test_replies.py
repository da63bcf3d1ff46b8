import json
import random
from datetime import datetime, timedelta

import pytest

from callgauge.operators import chunks
from callgauge.plans.ingest import Run
from callgauge.streaming import replies

LINE = "call_id STRING, seq BIGINT, data STRING, arrived_at TIMESTAMP, outcome STRING"


def delta(text):
    return json.dumps({"choices": [{"delta": {"content": text}}]})


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


class Case:
    """A job that is run after every delivery of (call, seq, data, minute)."""

    def __init__(self, spark, name, dialect="completions", **how):
        self.run, self.spark, self.how, self.dialect = Run(spark, name), spark, how, dialect

    def deliver(self, *lines):
        rows = [(c, n, d, None if m is None else at(m), "x") for c, n, d, m in lines]
        self.spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").json(self.run.topic)
        stream = self.spark.readStream.schema(LINE).json(self.run.topic)
        replies.start(stream, self.dialect, self.run.sink, self.run.checkpoint, **self.how).awaitTermination()
        return sorted((r.call_id, r.outcome, r.text) for r in replies.stored(self.spark, self.run.sink).collect())


def test_shuffled_over_batches_as_in_one_batch(spark):
    draw = random.Random(4)
    lines = []
    for call in range(12):
        n = draw.choice([0, 1, 5, 40])
        data = [draw.choice([delta(f"w{i} "), "no json", "", delta("é")]) for i in range(n)] + [chunks.DONE, delta("after")]
        lines += [(f"c{call}", i, d, 1) for i, d in enumerate(data)]
    copies = draw.sample(lines, 60)
    sent = lines + copies
    draw.shuffle(sent)
    case = Case(spark, "shuffled")
    for part in range(4):
        got = case.deliver(*sent[part::4])
    whole = chunks.reassemble(spark.createDataFrame([x[:3] for x in lines], "call_id string, seq bigint, data string"), "completions")
    assert got == sorted((r.call_id, "complete", r.text) for r in whole.collect())


def test_unfinished_late_and_forgotten(spark):
    case = Case(spark, "late", timeout=10, late_by=0, keep=60)
    assert case.deliver(("a", 0, delta("a0"), 0), ("a", 2, delta("a2"), 1), ("b", 0, delta("b0"), 5)) == []
    # a is given up when the watermark has passed its newest line by ten minutes, b not yet; gaps are left out
    got = case.deliver(("tick", 0, "", 12))
    assert got == [("a", "unfinished", "a0a2")]
    # a copy changes nothing, a new line is late; b goes on
    got = case.deliver(("a", 2, delta("a2"), 1), ("a", 1, delta("a1"), 2), ("b", 1, delta("b1"), 12), ("b", 2, chunks.DONE, 12))
    assert got == [("a", "late", "a1"), ("a", "unfinished", "a0a2"), ("b", "complete", "b0b1")]
    assert case.deliver(("b", 1, delta("b1"), 12), ("b", 3, delta("more"), 13)) == got
    # so old that the call may be forgotten: told under late, no state is made
    last = case.deliver(("tick", 1, "", 500))
    last = case.deliver(("a", 5, delta("a5"), 2), ("c", 0, delta("c0"), 3), ("d", 0, delta("d0"), 499))
    late = sorted(x for x in last if x[1] == "late")
    assert late == [("a", "late", "a1"), ("a", "late", "a5"), ("c", "late", "c0")] and "d" not in {c for c, *_ in last}


def test_messages(spark):
    case = Case(spark, "messages", "messages")
    say = lambda t: json.dumps({"type": "content_block_delta", "delta": {"text": t}})
    stop = json.dumps({"type": "message_stop"})
    assert case.deliver(("m", 2, stop, 0), ("m", 0, say("message_stop"), 0), ("n", 0, say('"type": "message_stop"'), 0)) == []
    assert case.deliver(("m", 1, say(" b"), 1)) == [("m", "complete", "message_stop b")]


def test_nulls_and_empty(spark):
    case = Case(spark, "nulls")
    assert case.deliver((None, 0, delta("x"), 0), ("a", None, delta("x"), 0), ("a", 5, delta("x"), None)) == []
    assert case.deliver(("a", 0, None, 0), ("a", 1, chunks.DONE, 0)) == [("a", "complete", "")]


def test_a_batch_that_broke_off_counts_once(spark, monkeypatch):
    case = Case(spark, "broken")
    case.deliver(("a", 0, delta("a0"), 0))
    write = replies.files.write_batch

    def broken(rows, batch_id, path):
        write(rows, batch_id, path)
        raise RuntimeError("worker lost")

    with monkeypatch.context() as m:
        m.setattr(replies.files, "write_batch", broken)
        with pytest.raises(Exception, match="worker lost"):
            case.deliver(("a", 1, delta("a1"), 0), ("a", 2, chunks.DONE, 0))
    assert case.deliver(("b", 0, chunks.DONE, 0)) == [("a", "complete", "a0a1"), ("b", "complete", "")]


def test_dialect(spark):
    with pytest.raises(ValueError):
        replies.start(spark.createDataFrame([], LINE), "other", "", "")
