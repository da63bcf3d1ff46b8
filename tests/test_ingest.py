import json
import time

import pytest
from pyspark.sql import functions as F

from callgauge.operators import validate
from callgauge.plans.ingest import Run
from callgauge.schemas import ENVELOPE
from callgauge.sources import bus, envelopes
from callgauge.streaming import ingest, live, sink

GOOD = {"requestId": "r1", "provider": "p", "model": "m", "streaming": True, "status": "success", "requestedAt": "2024-01-01T00:00:00.5Z"}


def envelope(**changes):
    return json.dumps({k: v for k, v in (GOOD | changes).items() if v is not ...})


def issues(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    checked = validate.check(envelopes.parse(df)).orderBy("i")
    return [[(x.path, x.code) for x in r.issues] for r in checked.collect()]


def test_verdicts(spark):
    assert issues(
        spark, envelope(), envelope(provider=...), envelope(provider=None), envelope(latencyMs=-1.5), envelope(metadata=[]), "5", "null", "[]",
        envelope(inputPreview="\U0001f600" * 2000), envelope(inputPreview="\U0001f600" * 2001), envelope(inputPreview="é" * 4000),
        envelope(requestedAt="2024-01-01T24:00:00Z"), envelope(requestedAt="2024-01-01 00:00:00Z"), envelope(requestedAt="2023-02-29T00:00:00Z"),
    ) == [
        [], [("provider", "invalid_type")], [("provider", "invalid_type")], [("latencyMs", "invalid_type"), ("latencyMs", "too_small")],
        [("metadata", "invalid_type")], [("", "invalid_type")], [("", "invalid_type")], [("", "invalid_type")],
        [], [("inputPreview", "too_big")], [],
        [("requestedAt", "invalid_string")], [("requestedAt", "invalid_string")], [("requestedAt", "invalid_string")],
    ]


def test_issues_come_in_the_order_of_the_keys(spark):
    assert [p for p, _ in issues(spark, "{}")[0]] == [f.name for f in ENVELOPE if f.required]


def test_repeated_key_and_text_after_the_value(spark):
    one = '{"a":1}'
    tails = ["]", "] tail", "],[" + one, "}", "} x", "}{", ",", "," + one, one, " x", "]}", "}]", '],"v":[1', '},{"v":1', "\x00", "//"]
    df = spark.createDataFrame([(one + t,) for t in tails], "payload string")
    assert [r[0] for r in envelopes.parse(df).select(F.to_json("log")).collect()] == [None] * len(tails)
    texts = ['{"a":1,"a":2}', '{"a":1} x', '{"a":1}{"a":2}', '{"a":1},{"a":2}', "", None, " {}\t\r\n "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    assert [r[0] for r in envelopes.parse(df).orderBy("i").select(F.to_json("log")).collect()] == ['{"a":2}', None, None, None, None, None, "{}"]


def batch_issues(spark, body):
    df = spark.createDataFrame([(body,)], "body string")
    return [(x.path, x.code) for x in validate.check_batches(envelopes.parse(df, "body", "batch")).first().issues]


@pytest.mark.parametrize("n, want", [(0, [("logs", "too_small")]), (1, []), (500, []), (501, [("logs", "too_big")])])
def test_batch_bounds(spark, n, want):
    assert batch_issues(spark, '{"logs":[' + ",".join([envelope()] * n) + "]}") == want


def test_batch_of_something_else(spark):
    for body in ("{}", '{"logs":null}', '{"logs":{"a":1}}', "[]", "{bad", '{"logs":"x"}'):
        assert batch_issues(spark, body) == [("logs", "invalid_type")]
    mixed = '{"logs":[' + envelope() + ",5,null," + envelope(status="x") + "]}"
    assert batch_issues(spark, mixed) == [("logs.1", "invalid_type"), ("logs.2", "invalid_type"), ("logs.3.status", "invalid_enum_value")]


def test_sender_is_told_twenty_issues(spark):
    df = spark.createDataFrame([('{"logs":[' + ",".join([envelope(status="x")] * 25) + "]}",)], "body string")
    checked = validate.check_batches(envelopes.parse(df, "body", "batch"))
    row = checked.select(F.size("issues"), F.size(validate.first_issues(F.col("issues")))).first()
    assert tuple(row) == (25, 20)


def test_payload_field(spark):
    fields = [["payload", "a"], ["x", "payload", "payload", "b"], ["x", "payload"], [], ["payload", "a", "payload", "b"], ["payload"]]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "i int, f array<string>").orderBy("i")
    assert [r[0] for r in df.select(envelopes.payload_field(F.col("f"))).collect()] == ["a", "b", None, None, "a", None]


def test_unknown_keys_are_dropped(spark):
    df = spark.createDataFrame([(envelope(extra=1),)], "payload string")
    kept = json.loads(envelopes.parse(df).select(validate.strip_unknown(F.col("log"))).first()[0])
    assert kept == GOOD


def test_start_position():
    options = bus.kafka_options("host:9092", "logs", max_offsets=50)
    assert (options["startingOffsets"], options["maxOffsetsPerTrigger"]) == ("earliest", "50")
    assert bus.kafka_options("h", "t", "latest")["startingOffsets"] == "latest"
    with pytest.raises(ValueError):
        bus.kafka_options("h", "t", "middle")


def publish(run, *rows):
    run.publish(run.spark.createDataFrame(rows, "stream_seq long, payload string"))


def stored(run):
    return {r.request_id: r.latency_ms for r in run.logs().collect()}


@pytest.mark.parametrize("scope", ["index", "all", "date"])
def test_first_write_wins_within_and_between_batches(spark, scope):
    run = Run(spark, "first")
    publish(run, (3, envelope(latencyMs=3)), (1, envelope(latencyMs=1)), (2, envelope(latencyMs=2)), (4, envelope(requestId="r2")))
    run.ingest(dedupe_scope=scope)
    publish(run, (0, envelope(latencyMs=0)), (5, envelope(requestId="r3", latencyMs=5)))
    run.ingest(dedupe_scope=scope)
    assert stored(run) == {"r1": 1, "r2": None, "r3": 5}
    counts = [tuple(r) for r in ingest.counts(spark, run.sink).orderBy("batch_id").select("received", "rejected", "inserted", "duplicates").collect()]
    assert counts == [(4, 0, 2, 2), (2, 0, 1, 1)]


def test_state_scope(spark):
    run = Run(spark, "state")
    publish(run, (1, envelope()), (2, envelope()), (3, "{bad"), (4, "null"))
    run.ingest(dedupe_scope="state")
    publish(run, (5, envelope()), (6, envelope(requestId="r2")), (7, "{bad"))
    run.ingest(dedupe_scope="state")
    assert sorted(stored(run)) == ["r1", "r2"] and run.logs().count() == 2
    assert spark.read.parquet(run.dead).where("reason = 'corrupt'").count() == 3
    # copies are gone before they are counted
    counts = ingest.counts(spark, run.sink).orderBy("batch_id").select("received", "rejected", "inserted", "duplicates").collect()
    assert [tuple(r) for r in counts] == [(None, 2, 1, None), (None, 1, 1, None)]


@pytest.mark.parametrize("scope", ["index", "all", "date", "state"])
def test_equal_offsets_of_two_partitions(spark, scope):
    run = Run(spark, "partitions")
    for partition in (0, 1):
        rows = spark.createDataFrame([(4, "{bad"), (5, envelope(requestId=f"r{partition}")), (6, envelope(status="x"))], "stream_seq long, payload string")
        run.publish(rows, partition=partition)
    run.ingest(dedupe_scope=scope)
    assert sorted(stored(run)) == ["r0", "r1"]
    dead = [tuple(r) for r in spark.read.parquet(run.dead).select("partition", "offset").collect()]
    assert sorted(dead) == [(0, 4), (0, 6), (1, 4), (1, 6)]


def test_the_job_sets_what_it_depends_on(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    run = Run(spark, "plain")
    publish(run, (1, envelope()[:-1] + ', "latencyMs": 1, "latencyMs": 2}'))
    run.ingest()
    assert stored(run) == {"r1": 2}


def by_day(day, *ids):
    return [(100 * day + i, envelope(requestId=f"d{day}-{i}", latencyMs=i, requestedAt=f"2024-01-{day:02d}T00:00:00Z")) for i in ids]


def test_compaction_keeps_every_row(spark):
    run = Run(spark, "compact")
    for day in range(1, 6):
        publish(run, *by_day(day, 1, 2, 2), *by_day(1, day), (day, "{bad"))
        run.ingest()
    before = sorted(tuple(r) for r in run.logs().drop("batch_id").collect())
    minutes = sorted(tuple(r) for r in ingest.minute_counts(spark, run.sink).collect())
    total = ingest.counts(spark, run.sink).agg(*[F.sum(c) for c in ("received", "rejected", "inserted", "duplicates")]).first()
    ingest.compact(spark, run.sink)
    assert len(sink.batches(spark, run.sink)) == 2
    ingest.compact(spark, run.sink)
    assert sorted(tuple(r) for r in run.logs().drop("batch_id").collect()) == before
    assert sorted(tuple(r) for r in ingest.minute_counts(spark, run.sink).collect()) == minutes
    assert ingest.counts(spark, run.sink).agg(*[F.sum(c) for c in ("received", "rejected", "inserted", "duplicates")]).first() == total
    publish(run, *by_day(1, 1, 2, 9), *by_day(7, 1))
    run.ingest()
    assert run.logs().count() == len(before) + 2


@pytest.mark.parametrize("left", ["nothing", "rows", "done", "deleted", "moved"])
def test_broken_compaction_is_finished(spark, left):
    """Broken off after any of its steps."""
    run = Run(spark, "broken")
    for day in (1, 2, 3):
        publish(run, *by_day(day, 1, 2))
        run.ingest()
    want = sorted(r.request_id for r in run.logs().collect())
    fs, path = sink._fs(spark, run.sink), lambda p: sink._path(spark, f"{run.sink}/{p}")
    if left != "nothing":
        merged = run.logs().where("batch_id <= 1").drop("batch_id")
        if left == "rows":
            merged = merged.limit(1)
        sink.write_batch(merged, 1, f"{run.sink}/{sink.STAGE}", "requested_date")
    if left in ("done", "deleted", "moved"):
        fs.create(path(f"{sink.STAGE}/_DONE")).close()
    if left in ("deleted", "moved"):
        fs.delete(path("batch_id=0"), True)
        fs.delete(path("batch_id=1"), True)
    if left == "moved":
        fs.rename(path(f"{sink.STAGE}/batch_id=1"), path("batch_id=1"))
    sink.finish_compaction(spark, run.sink)
    assert sorted(r.request_id for r in run.logs().collect()) == want
    assert not sink.exists(spark, f"{run.sink}/{sink.STAGE}")


def test_a_batch_reads_the_folders_of_its_dates(spark):
    run = Run(spark, "dates")
    for day in (1, 2, 3):
        publish(run, *by_day(day, 1))
        run.ingest()
    known = ingest._of_dates(run.logs(), spark.sql("select date'2024-01-02' as requested_date"))
    files = [f for f in known.select("request_id").inputFiles()]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01-02" in plan.split("PartitionFilters: [")[1].split("]")[0] or "19724" in plan
    assert known.count() == 1 and files


def test_nothing_is_written_for_nothing(spark):
    run = Run(spark, "empty")
    publish(run, (1, envelope()))
    run.ingest()
    assert not sink.exists(spark, run.dead)
    publish(run, (2, "{bad"))
    run.ingest()
    assert sink.batches(spark, run.sink) == sink.batches(spark, f"{run.sink}_minutes") == [0]


def test_live_table_is_compacted(spark):
    run = Run(spark, "live")
    for n, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2)], [("b", 3), ("c", 3)])):
        sink.write_batch(spark.createDataFrame(rows, "k string, v int"), n, run.sink)
    live.compact(spark, run.sink, "k", keep=0)
    assert sink.batches(spark, run.sink) == [2]
    assert sorted(tuple(r) for r in sink.newest(sink.read(spark, run.sink), "k").collect()) == [("a", 2), ("b", 3), ("c", 3)]


def test_rejected_entries_keep_their_payload(spark):
    run = Run(spark, "dead")
    bad = [(1, "{bad"), (2, "null"), (3, envelope(status="x")), (4, envelope(requestId="big", latencyMs=3000000000)), (5, envelope())]
    publish(run, *bad)
    run.ingest()
    dead = {r.offset: (r.reason, r.payload) for r in spark.read.parquet(run.dead).collect()}
    assert dead == {1: ("corrupt", bad[0][1]), 2: ("corrupt", "null"), 3: ("invalid", bad[2][1]), 4: ("out_of_range", bad[3][1])}
    row = run.logs().first()
    assert (row.request_id, row.tokens_estimated, row.pii_redacted, row.metadata, str(row.requested_date)) == ("r1", False, False, "{}", "2024-01-01")


@pytest.mark.parametrize("stage", ["read", "written"])
def test_broken_run_is_replayed(spark, stage):
    run = Run(spark, "replay")
    publish(run, *[(i, envelope(requestId=f"r{i % 5}", latencyMs=i)) for i in range(8)])
    run.ingest_failing(stage)
    publish(run, (9, envelope(requestId="r1")), (10, envelope(requestId="r9", latencyMs=10)))
    run.ingest()
    assert stored(run) == {"r0": 0, "r1": 1, "r2": 2, "r3": 3, "r4": 4, "r9": 10} and run.logs().count() == 6
    assert ingest.minute_counts(spark, run.sink).agg(F.sum("calls")).first()[0] == 6


def test_duplicates_only(spark):
    run = Run(spark, "again")
    for seq in (1, 2):
        publish(run, (seq, envelope()))
        run.ingest()
    assert run.logs().count() == 1 and ingest.minute_counts(spark, run.sink).agg(F.sum("calls")).first()[0] == 1


def test_one_id_delivered_most_often(spark):
    run = Run(spark, "hot")
    publish(run, *[(i, envelope(requestId="hot" if i % 3 else f"r{i}", latencyMs=i)) for i in range(300)])
    run.ingest()
    assert run.logs().count() == 101 and stored(run)["hot"] == 1
    other = Run(spark, "hot_state")
    publish(other, *[(i, envelope(requestId="hot" if i % 3 else f"r{i}", latencyMs=7)) for i in range(300)])
    other.ingest(dedupe_scope="state")
    assert ingest.minute_counts(spark, other.sink).first().calls == 101


def test_events_round_trip(spark):
    df = spark.createDataFrame([(envelope(conversationId="0b0e7a3c-7a52-4d5a-9c1f-0123456789ab", metadata={"a": [1, None]}, latencyMs=5),)], "payload string")
    rows = validate.typed_rows(envelopes.parse(df))
    back = envelopes.to_events(rows).first()
    assert back.key == "r1"
    assert json.loads(back.value) == GOOD | {
        "conversationId": "0b0e7a3c-7a52-4d5a-9c1f-0123456789ab", "latencyMs": 5, "tokensEstimated": False, "metadata": {"a": [1, None]},
        "requestedAt": "2024-01-01T00:00:00.500000Z",
    }


def test_unknown_scope_is_refused(spark):
    with pytest.raises(ValueError):
        ingest.start(spark.range(1), "a", "b", "c", dedupe_scope="some")


def test_published_files_are_compressed_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(bus, "PER_FILE", 3)
    run = Run(spark, "bounded")
    publish(run, *[(i, envelope(requestId=f"r{i}")) for i in range(40)])
    names = [n for n in sink.names(spark, run.topic) if n.startswith("part-")]
    assert len(names) >= 14 and all(n.endswith(".json.gz") for n in names)
    assert bus.latest(spark, run.topic, run.checkpoint) > 0
    run.ingest()
    assert run.logs().count() == 40


def test_a_payload_is_read_once_each_way(spark):
    plan = envelopes.parse(spark.createDataFrame([("{}",)], "payload string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("variant_get") == 0


def classified(spark, *payloads):
    """Entries with the payloads, as the ingest job reads them."""
    return ingest.classify(spark.createDataFrame([(0, i, ["payload", p]) for i, p in enumerate(payloads)], bus.ENTRY))


def test_long_preview_is_judged_in_a_moment(spark):
    rows = classified(spark, envelope(inputPreview="i" * 200_000, outputPreview="o" * 4000 + " 555 123 4567"), envelope(outputPreview="o" * 4000))
    start = time.perf_counter()
    told = [(r["reason"], r["output_preview"]) for r in rows.orderBy("offset").collect()]
    assert time.perf_counter() - start < 10
    assert told == [("invalid", "o" * 4000 + " [PHONE_REDACTED]"), (None, "o" * 4000)]


def test_what_is_no_object_is_corrupt(spark):
    payloads = ["5", "null", "[]", "[{}]", '"{}"', "{}{}", "{bad", " x", "{}", envelope(status=...), envelope(latencyMs=3e9), envelope()]
    want = ["corrupt"] * 8 + ["invalid", "invalid", "out_of_range", None]
    assert [r["reason"] for r in classified(spark, *payloads).orderBy("offset").collect()] == want


def test_reading_of_entries_is_compiled(spark):
    """No generator but the one of ``from_json`` is interpreted (it has no star), and no method is too long for the JVM's compiler."""
    plan = classified(spark, envelope())._jdf.queryExecution().executedPlan()
    steps = [line for line in plan.toString().splitlines() if "Generate inline" in line]
    interpreted = [line for line in steps if "*(" not in line.split("Generate inline")[0]]
    assert len(steps) == 5 and ["from_json" in line for line in interpreted] == [True]
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    made = debug.codegenStringSeq(plan)
    assert made.size() and all(made.apply(i)._3().maxMethodCodeSize() <= 8000 for i in range(made.size()))
