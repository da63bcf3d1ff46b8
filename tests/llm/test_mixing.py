import pytest
from helpers import docs
from pyspark.sql import functions as F

from callgauge.llm import mixing


def fill(sizes, weights, total):
    """Water-filling one source at a time, in exact order of cap by weight."""
    left, weight, out = total, sum(weights), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: 2 * sizes[i] / weights[i]):
        out[i] = min(2 * sizes[i], left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1], [1, 1000, 30, 7, 0, 512], [5], [0, 0], [3, 90, 6000, 2, 44, 44, 44, 9]])
def test_targets(spark, sizes):
    names = [f"s{i:02d}" for i in range(len(sizes))]
    totals = spark.createDataFrame([(n, s) for n, s in zip(names, sizes)], "source string, source_size long")
    got = {r.source: r for r in mixing.targets(mixing.weighted(totals)).collect()}
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    assert [got[n].weight for n in names] == weights
    assert [got[n].target for n in names] == pytest.approx(fill(sizes, weights, 1.5 * sum(sizes)))


def test_order_of_sources(spark):
    names = ["b", None, "a", "Z", "é", "", "\U0001f600", "\uffff"]
    totals = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long")
    got = {r.source: r.weight for r in mixing.weighted(totals).collect()}
    order = sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None]
    assert [got[n] for n in order] == [mixing.WEIGHTS[i % 3] for i in range(len(names))]


def test_taken_comes_near_the_target(spark):
    rows = [(i, "w " * (1 + i % 40), "hot" if i % 3 else f"s{i % 11}") for i in range(3000)]
    rows += [(None, "a b", "hot"), (5000, None, "hot"), (5001, "", None), (5002, "x \x0b y", None), (5002, "x \x0b y", None)]
    df = docs(spark, rows, ["size", "plan", "place", "target"])
    first = mixing.mix(df)
    got = first.collect()
    assert len(got) == len(rows)
    assert all(r.taken in (r.size * r.repeats, 0) and 0 <= r.taken <= 2 * r.size for r in got)
    by = first.groupBy("source", "source_size", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.target) <= r.m for r in by)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)


def test_only_as_many_equal_rows_as_fit(spark):
    rows = [(7, "a b c", "hot")] * 400 + [(None, "a b", "none")] * 300 + [(7, "a b c", None)] * 500
    rows += [(i, "w " * (1 + i % 9), "other") for i in range(300)]
    df = docs(spark, rows, ["plan_part", "size", "tie"]).repartition(5)
    first = mixing.mix(df)
    assert first.count() == len(rows)
    by = first.groupBy("source", "target").agg(F.sum("taken").alias("t"), F.max("size").alias("m")).collect()
    assert len(by) == 4 and all(abs(r.t - r.target) <= r.m for r in by)
    assert sorted(first.collect(), key=repr) == sorted(mixing.mix(df.repartition(3)).collect(), key=repr)


def test_empty(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    only = mixing.mix(docs(spark, [(1, ""), (2, None)])).collect()
    assert [(r.target, r.taken) for r in only] == [(0.0, 0), (0.0, 0)]
