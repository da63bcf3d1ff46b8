import random
from datetime import datetime, timedelta

import pytest

from callgauge.operators import cost

CALLS = "request_id string, provider string, model string, requested_at timestamp, prompt_tokens int, completion_tokens int, price string, _at int"
PRICES = "provider string, model string, valid_from timestamp, prompt_price bigint, completion_price bigint, request_id string"
START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def plain(calls, prices):
    out = []
    for rid, provider, model, when, prompt, completion, *_ in calls:
        valid = [p[2:5] for p in prices if None not in (*p[:3], when, provider, model) and p[:2] == (provider, model) and p[2] <= when]
        best = max(valid, default=None)
        out.append((rid, best, None if best is None else (prompt or 0) * best[1] + (completion or 0) * best[2]))
    return sorted(out, key=repr)


def priced(spark, calls, prices, **how):
    rows = spark.createDataFrame(calls, CALLS).drop("price")
    found = cost.with_prices(rows, spark.createDataFrame(prices, PRICES), **how)
    return sorted(((r.request_id, r.price and tuple(r.price)) for r in found.collect()), key=repr)


def case():
    draw = random.Random(5)
    names = [("a", "m"), ("a", "n"), ("b", "m"), (None, "m"), ("a", None)]
    calls = [
        (f"r{draw.randrange(250)}", *draw.choice(names), draw.choice([None, *map(at, range(0, 20_000, 7))]),
         draw.choice([None, 0, 5, 2**31 - 1]), draw.choice([None, 3]), "x", 1)
        for _ in range(300)
    ]
    # bursts within a second, at the borders of blocks, long gaps, repeated instants
    times = [*range(300, 310), 3599, 3600, 3601, 7200, 18_000]
    prices = [(*draw.choice(names), draw.choice([None, *map(at, times)]), draw.randrange(10**12), draw.randrange(100), "y") for _ in range(60)]
    prices += [p[:3] + (p[3] + 1, *p[4:]) for p in prices[:5]]
    return calls, prices


@pytest.mark.parametrize("parts, block", [(1, 10), (16, 3600), (3, 10**9)])
def test_against_brute_force(spark, parts, block):
    calls, prices = case()
    assert priced(spark, calls, prices, parts=parts, block=block) == sorted([r[:2] for r in plain(calls, prices)], key=repr)


def test_cost_is_exact_and_keeps_columns(spark):
    calls, prices = case()
    rows = spark.createDataFrame(calls, CALLS).drop("price")
    costed = cost.with_cost(rows, spark.createDataFrame(prices, PRICES))
    assert costed.columns == [*rows.columns, "price", "cost_pico"]
    want = plain(calls, prices)
    got = [(r.request_id, r.price and tuple(r.price), r.cost_pico and int(r.cost_pico)) for r in costed.collect()]
    assert sorted(((a, b, c or 0) for a, b, c in got), key=repr) == sorted(((a, b, c or 0) for a, b, c in want), key=repr)
    total = cost.spend(costed).first()
    assert (total.requests, total.unpriced, int(total.cost_pico)) == (300, sum(c is None for *_, c in want), sum(c or 0 for *_, c in want))


def test_empty(spark):
    calls, prices = case()
    assert priced(spark, [], prices) == []
    assert {p for _, p in priced(spark, calls, [])} == {None}


def test_a_hot_model_is_cut_into_parts(spark):
    """The window is partitioned by block and part, and nothing is broadcast or paired with all."""
    calls, prices = case()
    found = cost.with_prices(spark.createDataFrame(calls, CALLS).drop("price"), spark.createDataFrame(prices, PRICES))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
    windows = [line for line in plan.splitlines() if " Window [" in line and "_is_call" in line]
    assert windows and all("_block" in w and "_part" in w for w in windows)
