import re
import uuid

import pytest
from pyspark.sql import functions as F

from callgauge.session import scratch_dir
from callgauge.sources import bucketed

LOGS = "request_id string, conversation_id string, status string, total_tokens int, latency_ms int, requested_at timestamp_ntz"


def rows_of(n_wide):
    import datetime as dt

    ids = ["wide"] * n_wide + [f"c{i % 40}" for i in range(200)] + [None] * 7 + ["gone"] * 2
    at = dt.datetime(2024, 1, 1)
    return [(f"r{i}", c, "error" if i % 5 == 0 else "success", i % 7, i, at + dt.timedelta(seconds=i)) for i, c in enumerate(ids)]


@pytest.fixture(scope="module")
def made(spark):
    logs = spark.createDataFrame(rows_of(120), LOGS)
    known = spark.createDataFrame([(c, f"title {c}", "active") for c in ("wide", *(f"c{i}" for i in range(40)), "idle")], "conv_id string, title string, status string")
    name = f"t_{uuid.uuid4().hex}"
    return logs, known, bucketed.write(logs, known, name, scratch_dir(spark, name), 4, wide_rows=50)


def plan(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def files_read(df):
    """Files that the tasks of a plan's one scan are given."""
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return sum(len(part.files()) for part in scan.inputRDD().partitions())


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_are_all_there_and_parted(spark, made):
    logs, _, store = made
    narrow, wide = spark.table(store.logs), spark.table(store.wide)
    assert sorted(map(repr, narrow.unionByName(wide).collect())) == sorted(map(repr, logs.collect()))
    assert {r[0] for r in wide.select("conversation_id").distinct().collect()} == {"wide", None}
    assert len(narrow.inputFiles()) <= 4


def test_a_lookup_reads_one_bucket(spark, made):
    logs, _, store = made
    found = bucketed.of_conversation(spark, store, "c3")
    assert files_read(spark.table(store.logs)) == 4
    assert files_read(spark.table(store.logs).where("conversation_id = 'c3'")) == 1
    assert [r.request_id for r in found.collect()] == [r.request_id for r in logs.where("conversation_id = 'c3'").orderBy(F.desc("requested_at")).collect()]
    assert bucketed.of_conversation(spark, store, "wide").count() == 120
    assert bucketed.of_conversation(spark, store, "nobody").count() == 0


def test_join_and_aggregate_do_not_shuffle_the_buckets(spark, made, no_broadcast):
    from callgauge.operators import transcript

    _, _, store = made
    known = bucketed.headers(spark, store)
    for df in (transcript.logs_with_conversation(spark.table(store.logs), known), transcript.conversation_usage(spark.table(store.logs), known)):
        assert not re.search(r"\bExchange\b", plan(df)), plan(df)
        assert "Bucketed: true" in plan(df)


def test_same_rows_as_from_plain_tables(spark, made, no_broadcast):
    from callgauge.operators import transcript

    logs, known, store = made
    for got, want in (
        (bucketed.with_conversation(spark, store), transcript.logs_with_conversation(logs, known)),
        (bucketed.usage(spark, store), transcript.conversation_usage(logs, known)),
    ):
        names = want.columns
        assert sorted(map(repr, got.select(names).collect())) == sorted(map(repr, want.collect()))


def test_no_rows(spark, made):
    logs, known, _ = made
    name = f"t_{uuid.uuid4().hex}"
    store = bucketed.write(logs.limit(0), known.limit(0), name, scratch_dir(spark, name), 2)
    assert bucketed.usage(spark, store).collect() == [] and bucketed.of_conversation(spark, store, "c3").collect() == []
