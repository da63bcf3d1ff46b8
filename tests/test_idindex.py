import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from callgauge.plans.ingest import Run
from callgauge.session import scratch_dir
from callgauge.streaming import idindex, ingest, sink
from test_ingest import by_day, envelope, publish, stored


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "request_id string")


def among(spark, index, names, before=10**6):
    """Those of ``names`` that the index holds, and what was read."""
    asked = ids(spark, *names)
    told = idindex.lookup(spark, index, asked, "request_id", len(names), before)
    known = set() if told.ids is None else {r[0] for r in told.ids.join(asked, "request_id", "left_semi").collect()}
    return known, told


@pytest.mark.parametrize("per_bucket", [2, 1 << 20])
def test_finds_what_is_stored_and_nothing_else(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(idindex, "PER_BUCKET", per_bucket)
    monkeypatch.setattr(idindex, "PER_TASK", 7)
    index, rng, held = scratch_dir(spark, "ids"), random.Random(1), set()
    for batch in range(4):
        new = {f"r{rng.randrange(10**9)}" for _ in range(15)} - held
        idindex.add(ids(spark, *new), index, batch, batch, len(new))
        held |= new
    some = rng.sample(sorted(held), 20)
    other = [f"x{i}" for i in range(20)]
    assert among(spark, index, some + other + ["", "é"])[0] == set(some)
    assert among(spark, index, other[:1])[0] == set()
    assert among(spark, index, sorted(held), before=0)[0] == set()


def test_files_read_stay_the_same_over_fifty_batches(spark):
    index, read = scratch_dir(spark, "many"), []
    for batch in range(50):
        names = [f"b{batch}-{i}" for i in range(20)]
        again = ["b0-3", f"b{batch - 1}-5"] if batch % 10 == 9 else []
        known, told = among(spark, index, names + again, batch)
        assert known == set(again)
        read.append((told.filters_read, told.files_read))
        idindex.add(ids(spark, *names), index, batch, batch, 20)
        idindex.merge(spark, index, batch)
    levels = 2  # 8 ** 2 batches are more than 50
    assert max(f for f, _ in read) <= levels * (idindex.MERGE - 1) + 1
    # new ids read no file, copies the files they are in, however many batches there were
    assert {f for n, (_, f) in enumerate(read) if n % 10 != 9} == {0}
    assert all(1 <= f <= 2 for n, (_, f) in enumerate(read) if n % 10 == 9)
    assert sum(s.n for s in idindex.segments(spark, index)) == 1000


@pytest.mark.parametrize("left", ["nothing", "written", "marked", "unmarked"])
def test_broken_merge(spark, monkeypatch, left):
    """Broken off after any of its steps, then done again."""
    monkeypatch.setattr(idindex, "MERGE", 2)
    index = scratch_dir(spark, "broken")
    for batch in range(3):
        idindex.add(ids(spark, f"r{batch}"), index, batch, batch, 1)
    if left == "written":
        ids(spark, "half").write.parquet(f"{index}/0-1/ids")
    if left in ("marked", "unmarked"):
        idindex.add(ids(spark, "r0", "r1"), index, 0, 1, 2, 1)
    if left == "unmarked":
        sink.delete(spark, f"{index}/{idindex.Segment(0, 0, 0, 0, 1).marker}")
    assert among(spark, index, ["r0", "r1", "r2", "half"])[0] == {"r0", "r1", "r2"}
    idindex.merge(spark, index, 2)
    assert [(s.name, s.n) for s in idindex.segments(spark, index)] == [("0-1", 2), ("2-2", 1)]
    assert among(spark, index, ["r0", "r1", "r2", "half"])[0] == {"r0", "r1", "r2"}


def test_a_batch_that_is_run_again_replaces_its_segment(spark):
    index = scratch_dir(spark, "again")
    idindex.add(ids(spark, "a"), index, 0, 0, 1)
    idindex.add(ids(spark, "b", "c"), index, 1, 1, 2)
    assert among(spark, index, ["a", "b"], before=1)[0] == {"a"}
    idindex.add(ids(spark, "d"), index, 1, 1, 1)
    assert among(spark, index, ["a", "b", "c", "d"])[0] == {"a", "d"}


def resent(day, i):
    return 100 * day + i + 50, envelope(requestId=f"d1-{i}", latencyMs=99, requestedAt=f"2024-02-{day:02d}T00:00:00Z")


def test_a_request_is_stored_once_whatever_its_time(spark):
    run = Run(spark, "resent")
    publish(run, *by_day(1, 1, 2, 3))
    run.ingest()
    publish(run, resent(2, 1), resent(2, 1), *by_day(2, 1))
    run.ingest()
    ingest.compact(spark, run.sink, keep=0)
    publish(run, resent(3, 2), *by_day(3, 1))
    run.ingest()
    assert stored(run) == {"d1-1": 1, "d1-2": 2, "d1-3": 3, "d2-1": 1, "d3-1": 1} and run.logs().count() == 5
    counts = [tuple(r) for r in ingest.counts(spark, run.sink).orderBy("batch_id").select("received", "inserted", "duplicates").collect()]
    assert counts == [(6, 4, 2), (2, 1, 1)]


def test_a_table_kept_in_another_scope_is_taken_over(spark):
    run = Run(spark, "taken_over")
    for day in (1, 2):
        publish(run, *by_day(day, 1, 2, 3))
        run.ingest(dedupe_scope="date")
    publish(run, *by_day(4, 1))
    run.ingest()
    publish(run, *by_day(5, 1), (507, "{bad"))
    run.ingest(dedupe_scope="all")
    publish(run, resent(6, 1), *by_day(2, 2), *by_day(4, 1), *by_day(5, 1), *by_day(6, 1))
    run.ingest()
    assert run.logs().count() == 9 and stored(run)["d1-1"] == 1


@pytest.mark.parametrize("stage", ["read", "written"])
def test_broken_run(spark, stage):
    run = Run(spark, "broken_run")
    publish(run, *by_day(1, 1, 2))
    run.ingest()
    publish(run, resent(2, 1), *by_day(2, 1, 2))
    run.ingest_failing(stage)
    run.ingest()
    assert sorted(stored(run)) == ["d1-1", "d1-2", "d2-1", "d2-2"] and run.logs().count() == 4
    publish(run, *by_day(2, 1, 2, 3))
    run.ingest()
    assert run.logs().count() == 5


def test_a_filter_takes_little_more_memory_than_its_bits(monkeypatch):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({c: rng.integers(-(2**63), 2**63 - 1, 200_000) for c in "ab"})
    tracemalloc.start()
    made = idindex._filter(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25_000_000
    assert all(idindex._passes(rows.iloc[i : i + 1], made) for i in (0, 99_999, 199_999))
    some = rows.head(100)
    whole = idindex._filter(some)
    monkeypatch.setattr(idindex, "AT_ONCE", 7)
    assert idindex._filter(some) == whole
    strange = pd.DataFrame({c: rng.integers(-(2**63), 2**63 - 1, 50) for c in "ab"})
    assert not idindex._passes(strange, whole) and idindex._passes(pd.concat([strange, some.tail(1)]), whole)
