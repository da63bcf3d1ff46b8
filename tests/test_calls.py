import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callgauge.functions.tokens import estimate_prompt, estimate_tokens
from callgauge.operators import calls, chunks

CALL = """request_id string, conversation_id string, message_id string, provider string, model string, streaming boolean,
 messages array<struct<role string, content string>>, output string, err_name string, err_code string, err_message string,
 http_status int, err_body string, finish_reason string, usage_prompt long, usage_completion long, usage_total long,
 usage_estimated boolean, started_at timestamp_ntz, first_delta_at timestamp_ntz, ended_at timestamp_ntz, metadata string"""
START = datetime(2024, 1, 1)


def call(**given):
    row = dict.fromkeys([part.split()[0] for part in CALL.replace("<role string, content string>", "").replace("\n", "").split(",")])
    row |= {
        "request_id": "r", "provider": "openai", "model": "m", "streaming": True,
        "messages": [("system", "abcde"), ("user", "one"), ("assistant", "two"), ("user", "abcd")], "output": "hello",
        "started_at": START, "first_delta_at": START + timedelta(milliseconds=120), "ended_at": START + timedelta(seconds=2),
        "metadata": '{"surface":"chat"}',
    } | given
    return tuple(row.values())


def log(spark, **given):
    options = given.pop("options", {})
    return calls.call_to_log(spark.createDataFrame([call(**given)], CALL), **options).first()


def test_success_without_usage_is_estimated(spark):
    row = log(spark, finish_reason="stop")
    assert (row.status, row.latency_ms, row.ttft_ms, row.input_preview, row.output_preview) == ("success", 2000, 120, "abcd", "hello")
    assert (row.prompt_tokens, row.completion_tokens, row.total_tokens, row.tokens_estimated) == (6 + 5 + 5 + 5, 2, 23, True)
    assert row.metadata == '{"surface":"chat","finishReason":"stop"}'


def test_reported_usage_wins_and_total_may_disagree(spark):
    row = log(spark, usage_prompt=7, usage_completion=0, usage_total=100)
    assert (row.prompt_tokens, row.completion_tokens, row.total_tokens, row.tokens_estimated) == (7, 0, 100, False)
    assert log(spark, usage_prompt=7, usage_completion=0, usage_estimated=True).tokens_estimated is True


def test_zero_usage_of_a_stream(spark):
    as_sent = log(spark, usage_prompt=0, usage_completion=0)
    assert (as_sent.total_tokens, as_sent.tokens_estimated) == (0, False)
    documented = log(spark, usage_prompt=0, usage_completion=0, options={"zero_usage_is_missing": True})
    assert (documented.total_tokens, documented.tokens_estimated) == (23, True)


@pytest.mark.parametrize("status, kind", [(429, "rate_limit"), (500, "provider_5xx"), (404, "provider_4xx"), (200, "provider_4xx"), (None, "unknown")])
def test_error_class(spark, status, kind):
    row = log(spark, err_name="Error", http_status=status, err_body="b" * 400, err_message="lost")
    assert (row.status, row.error_type, row.output_preview, row.total_tokens, row.tokens_estimated) == ("error", kind, None, None, False)
    assert row.error_message == ("lost" if status is None else f"provider {status}: " + "b" * 300)


def test_abort_by_name_or_code_is_a_cancel(spark):
    for given in ({"err_name": "AbortError"}, {"err_name": "Error", "err_code": "ABORT_ERR"}):
        row = log(spark, **given, streaming=True)
        assert (row.status, row.completion_tokens, row.prompt_tokens, row.total_tokens, row.tokens_estimated) == ("cancelled", 2, None, None, True)
        assert row.metadata == '{"surface":"chat","partial":true}'


def test_abort_of_a_call_that_is_not_streamed_is_an_error(spark):
    row = log(spark, err_name="AbortError", err_message="aborted", streaming=False)
    assert (row.status, row.error_type, row.error_message) == ("error", "unknown", "aborted")
    assert (row.completion_tokens, row.total_tokens, row.tokens_estimated, row.output_preview) == (None, None, False, None)
    assert row.metadata == '{"surface":"chat"}'


def test_metadata_key_is_replaced_even_by_nothing(spark):
    given = '{"finishReason":"mine","n":{"a":[1,null]}}'
    assert log(spark, metadata=given, finish_reason="stop").metadata == '{"n":{"a":[1,null]},"finishReason":"stop"}'
    assert log(spark, metadata=given).metadata == '{"n":{"a":[1,null]}}'
    assert log(spark, metadata=None).metadata == "{}"


def test_previews_are_cut_before_redaction(spark):
    text = "x" * 493 + " me@x.io"
    cut = log(spark, output=text)
    assert cut.output_preview == text[:500] and not cut.pii_redacted
    clean = log(spark, output=text, options={"redact_first": True})
    assert clean.output_preview == ("x" * 493 + " [EMAIL_REDACTED]")[:500] and clean.pii_redacted


def test_unfinished_calls_have_no_row(spark):
    df = spark.createDataFrame([call(ended_at=None), call(request_id="done")], CALL)
    assert [r.request_id for r in calls.call_to_log(df).collect()] == ["done"]
    assert [r.request_id for r in calls.unfinished(df).collect()] == ["r"]


def test_no_user_message_gives_an_empty_preview(spark):
    assert log(spark, messages=[("system", "a")]).input_preview == ""


def test_token_fallback(spark):
    df = spark.createDataFrame([("",), ("abcde",), (None,)], "t string")
    assert [r[0] for r in df.select(estimate_tokens(F.col("t"))).collect()] == [0, 2, 0]
    prompt = spark.createDataFrame([([("user", "abcde"), ("user", "abcd")],)], "m array<struct<role string, content string>>")
    assert prompt.select(estimate_prompt(F.col("m"))).first()[0] == 11



# chunks


def lines(spark, *data, call_id=1):
    return spark.createDataFrame([(call_id, i, d) for i, d in enumerate(data)], "call_id long, seq long, data string").orderBy(F.desc("seq"))


def test_completions_stop_at_the_end_marker(spark):
    got = chunks.reassemble(
        lines(
            spark, "{bad", '{"choices":[{"delta":{"content":"a"},"finish_reason":"x"}]}', '{"choices":[{"delta":{"content":""}}]}',
            '{"choices":[{"delta":{"content":" b"},"finish_reason":""}],"usage":{"prompt_tokens":3}}', '{"usage":{"completion_tokens":4}}',
            "[DONE]", '{"choices":[{"delta":{"content":"c"},"finish_reason":"late"}]}',
        ),
        "completions",
    ).first()
    assert tuple(got) == (1, "a b", "x", 3, 4, 0)


def test_messages_events(spark):
    got = chunks.reassemble(
        lines(
            spark, '{"type":"message_start","message":{"usage":{"input_tokens":5}}}', '{"type":"content_block_delta","delta":{"text":"a"}}',
            "[DONE]", '{"type":"other","delta":{"text":"no"}}', '{"type":"message_delta","usage":{"output_tokens":2}}',
            '{"type":"content_block_delta","delta":{"text":"b"}}', '{"type":"message_delta","delta":{"stop_reason":"end"},"usage":{"output_tokens":9}}',
        ),
        "messages",
    ).first()
    assert tuple(got) == (1, "ab", "end", 5, 9, 14)


@pytest.mark.parametrize("done", [5, 16, 37, 99])
def test_reassembly_over_block_borders(spark, monkeypatch, done):
    monkeypatch.setattr(chunks, "BLOCK", 8)
    data = [f'{{"choices":[{{"delta":{{"content":"{i},"}}}}],"usage":{{"total_tokens":{i}}}}}' for i in range(100)]
    data[done] = "[DONE]"
    got = chunks.reassemble(lines(spark, *data), "completions").first()
    assert (got.text, got.usage_total) == ("".join(f"{i}," for i in range(done)), done - 1)


def test_join_text_in_order(spark, monkeypatch):
    monkeypatch.setattr(chunks, "BLOCK", 3)
    rows = spark.range(20).selectExpr("id % 2 as k", "id as n", "if(id = 6, null, cast(id as string)) as t").orderBy(F.desc("n"))
    got = {r.k: r.j for r in chunks.join_text(rows, "k", "n", "t", "-", "j").collect()}
    assert got == {0: "0-2-4-8-10-12-14-16-18", 1: "1-3-5-7-9-11-13-15-17-19"}


def test_data_lines_and_frames(spark):
    raw = spark.createDataFrame(
        [(1, ": c\ndata: a \r\n  data:b\n\nevent: x\ndata:\ndata: cut"), (2, 'data: {"a":\ndata: 1}\nevent: e1\nevent:e2\n\ndata: no\n\nevent: z\n\ndata: null\n\ndata: {}')],
        "call_id long, body string",
    )
    got = [(r.call_id, r.seq, r.data) for r in chunks.data_lines(raw).orderBy("call_id", "seq").collect()]
    assert got[:3] == [(1, 1, "a"), (1, 2, "b"), (1, 5, "")] and (2, 0, '{"a":') in got and (2, 11, "{}") not in got
    frames = [(r.call_id, r.seq, r.event, r.data) for r in chunks.frames(raw).orderBy("call_id", "seq").collect()]
    assert frames == [(2, 0, "e2", '{"a":1}'), (2, 3, "message", "null")]


def test_split_system(spark):
    df = spark.createDataFrame([([("system", "a"), ("user", "u"), ("system", "b")],), ([("user", "u")],)], "m array<struct<role string, content string>>")
    got = [r.s for r in df.select(chunks.split_system(F.col("m")).alias("s")).collect()]
    assert [(s.system, [m.role for m in s.messages]) for s in got] == [("a\nb", ["user"]), (None, ["user"])]


def test_responses(spark):
    def one(expr, body):
        return tuple(spark.createDataFrame([(body,)], "b string").select(expr(F.col("b")).alias("r")).first().r)

    assert one(chunks.completion_json, '{"choices":[],"usage":{"total_tokens":3}}') == ("", None, None, None, 3)
    assert one(chunks.completion_json, '{"choices":[],"usage":{"total_tokens":3}} x') == ("", None, None, None, None)
    assert one(chunks.messages_json, '{"content":[{"text":"a"},{"type":"t"},{"text":"b"}],"usage":{"input_tokens":4}}') == ("ab", None, 4, None, 4)
