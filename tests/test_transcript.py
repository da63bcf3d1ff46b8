import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from callgauge.operators import hotkeys, transcript
from callgauge.operators.dedupe import first_wins, not_stored

MESSAGES = "conversation_id long, turn long, role string, content string"


def talk(seed=0):
    """One conversation with most messages, some short ones, and gaps in the numbering wider than a block."""
    rng = random.Random(seed)
    rows = []
    for conversation in range(6):
        turn = 0
        for i in range(400 if conversation == 2 else rng.randint(1, 30)):
            rows.append((conversation, turn, "system" if i == 0 else ("user", "assistant")[rng.random() < 0.5], f"m{conversation}.{turn}"))
            turn += rng.choice([1, 1, 1, 2, 5, 90])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_context_window_over_block_borders(spark, block):
    rows = talk()
    df = spark.createDataFrame(rows, MESSAGES)
    got = {(r.conversation_id, r.turn): [m.content for m in r.context] for r in transcript.context_window(df, 20, block).collect()}
    want = {}
    for conversation in {r[0] for r in rows}:
        said = sorted(r for r in rows if r[0] == conversation and r[2] != "system")
        for i, r in enumerate(said):
            if r[2] == "user":
                want[r[0], r[1]] = [m[3] for m in said[max(0, i - 19) : i + 1]]
    assert got == want


@pytest.mark.parametrize("block", [4096, 7])
def test_next_value(spark, block):
    rows = talk(1)
    got = hotkeys.next_value(spark.createDataFrame(rows, MESSAGES), "conversation_id", "turn", "content", "next", block)
    want = {}
    for conversation in {r[0] for r in rows}:
        said = sorted(r for r in rows if r[0] == conversation)
        for r, following in zip(said, [*said[1:], None]):
            want[r[0], r[1]] = following and following[3]
    assert {(r.conversation_id, r.turn): r.next for r in got.collect()} == want


EVENT = "conv_id long, seq long, kind string, title string, provider string, model string, event_at timestamp_ntz"


def test_state_keeps_last_known_values_and_latches_cancel(spark):
    at = [datetime(2024, 1, 1, 0, 0, i) for i in range(9)]
    events = [
        (1, 0, "create", None, None, None, at[0]),
        (1, 1, "meta", "first", "openai", "a", at[1]),
        (1, 2, "cancel", None, None, None, at[2]),
        (1, 3, "meta", None, "mock", None, at[3]),
        (1, 4, "message", None, None, None, at[4]),
        (2, 0, "create", None, None, None, at[5]),
    ]
    got = {r.conv_id: r for r in transcript.state(spark.createDataFrame(events[::-1], EVENT)).collect()}
    one = got[1]
    assert (one.title, one.provider, one.model, one.status, one.created_at, one.updated_at) == ("first", "mock", "a", "cancelled", at[0], at[4])
    assert (got[2].title, got[2].status) == (None, "active")


def test_accept_turns(spark):
    conversations = spark.createDataFrame([(1, "active"), (2, "cancelled")], "conv_id long, status string")
    turns = spark.createDataFrame([(1, "hi"), (1, "  \n"), (2, "hi"), (3, "hi"), (None, "hi"), (3, "")], "conv_id long, message string")
    got = {(r.conv_id, r.message): r.outcome for r in transcript.accept_turns(turns, conversations).collect()}
    assert got == {
        (1, "hi"): "accepted", (1, "  \n"): "bad_request", (2, "hi"): "conversation_cancelled", (3, "hi"): "not_found",
        (None, "hi"): "bad_request", (3, ""): "bad_request",
    }


def test_title_once_set_stays(spark):
    df = spark.createDataFrame([(None, "x" * 70), ("", "y"), ("kept", "z")], "t string, m string")
    assert [r[0] for r in df.select(transcript.keep_title(F.col("t"), F.col("m"))).collect()] == ["x" * 60, "y", "kept"]


def test_missing_conversation_has_no_row(spark, folder):
    from callgauge.sources.views import conversation_events, messages

    assert transcript.get(transcript.state(conversation_events(spark, folder)), messages(spark, folder), -5).count() == 0


def test_logs_without_a_conversation_are_no_orphans(spark):
    logs = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "request_id string, conversation_id long")
    conversations = spark.createDataFrame([(1, "t", "active")], "conv_id long, title string, status string")
    assert [r.request_id for r in transcript.orphan_logs(logs, conversations).collect()] == ["b"]
    assert transcript.logs_with_conversation(logs, conversations).count() == 3


def test_first_wins_when_one_key_holds_most_copies(spark):
    rows = spark.range(20000).selectExpr("if(id % 3 > 0, 'hot', concat('k', id div 7)) as k", "20000 - id as seq", "id as v")
    want = {r.k: r.m for r in rows.groupBy("k").agg(F.min("seq").alias("m")).collect()}
    assert {r.k: r.seq for r in first_wins(rows, "k", "seq").collect()} == want
    plan = first_wins(rows, "k", "seq")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # one of them before the shuffle


@pytest.mark.parametrize("n_rows", [3, 10**9])
def test_not_stored(spark, n_rows):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    stored = spark.createDataFrame([("b",), ("x",)], "k string")
    assert sorted(r.k for r in not_stored(rows, stored, "k", n_rows).collect()) == ["a", "c"]


def test_many_rows_are_made_once_to_be_compared_with_the_stored_keys(spark):
    rows, stored = spark.range(3).selectExpr("cast(id as string) as k"), spark.range(2).selectExpr("cast(id as string) as k")
    found = not_stored(rows, stored, "k", 10**6)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert [r.k for r in found.collect()] == ["2"]
