"""What calls cost, by price tables that change over time.

A price row holds ``provider``, ``model``, ``valid_from`` and the prices of a million prompt and completion tokens in millionths
of the currency; it is valid until the model's next row. A call costs what was valid at its ``requested_at``, the row's own
instant included.

The as-of join is a sorted union: prices and calls of a model go through one window in the order of time. It is cut into blocks
of an hour, each with the price that was valid when it began, and every block into ``PARTS`` by the request id, each with all
prices of the block. So a model with a third of all calls is spread over hours times parts, a task reads its rows as a sorted
stream, and nothing is broadcast or paired: prices may be many and change within a second. What a model has in one task is a
row per hour and per price change.

Calls without provider, model or time, or before the first price, have no price and a null cost. Tokens that are null count
nothing. Of prices from one instant the greatest is valid. Prices without provider, model or time are not used. Columns of the
calls stay as they are, whatever their names; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

KEYS = ("provider", "model")
#: Width of a block in seconds, and parts it is cut into.
BLOCK = 3_600
PARTS = 16
PRICE = ("valid_from", "prompt_price", "completion_price")
#: The currency in the unit a token costs: a millionth of a millionth.
PICO = 10**12


def with_prices(calls: DataFrame, prices: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Adds ``price``, a struct of valid_from, prompt_price and completion_price."""
    of_block = F.floor(F.unix_seconds(F.col("_at").cast("timestamp")) / block)
    rows = calls.select(
        *[F.col(k).alias(f"_{k}") for k in KEYS],
        F.col("requested_at").alias("_at"),
        F.pmod(F.xxhash64("request_id"), F.lit(parts).cast("long")).alias("_part"),
        F.struct(*calls.columns).alias("_call"),
    ).withColumn("_block", of_block)
    known = prices.where(" and ".join(f"{c} is not null" for c in (*KEYS, "valid_from")))
    changes = known.select(
        *[F.col(k).alias(f"_{k}") for k in KEYS], F.col("valid_from").alias("_at"), F.struct(*PRICE).alias("_price")
    ).withColumn("_block", of_block)
    keys = [f"_{k}" for k in KEYS]
    # a price for the start of every block with calls in it; both sides are a row per model and block before they meet
    last = changes.groupBy(*keys, "_block").agg(F.max("_price").alias("_price"))
    blocks = rows.where(" and ".join(f"{c} is not null" for c in (*keys, "_block"))).select(*keys, "_block").distinct()
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        blocks.withColumn("_called", F.lit(True))
        .join(last, [*keys, "_block"], "full")
        .withColumn("_price", F.last("_price", ignorenulls=True).over(before))
        .where(F.col("_called") & F.col("_price").isNotNull())
        .select(*keys, F.col("_price.valid_from").alias("_at"), "_price", "_block")
    )
    every_part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    valid = changes.select(*keys, "_at", "_price", "_block").unionByName(carried).withColumn("_part", every_part)
    both = rows.withColumn("_is_call", F.lit(True)).unionByName(
        valid.withColumn("_is_call", F.lit(False)), allowMissingColumns=True
    )
    so_far = W.partitionBy(*keys, "_block", "_part").orderBy("_at", "_is_call", "_price").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_price", F.last("_price", ignorenulls=True).over(so_far)).where("_is_call")
    return found.select("_call.*", F.col("_price").alias("price"))


def with_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds ``price`` and ``cost_pico``, an exact whole number of 1/``PICO`` of the currency, decimal(38, 0)."""
    exact = [
        F.coalesce(F.col(f"{side}_tokens"), F.lit(0)).cast("decimal(18,0)") * F.col(f"price.{side}_price").cast("decimal(18,0)")
        for side in ("prompt", "completion")
    ]
    return with_prices(calls, prices).withColumn("cost_pico", (exact[0] + exact[1]).cast("decimal(38,0)"))


def spend(costed: DataFrame, *keys: str) -> DataFrame:
    """Calls, those without a price, and what the others cost, per group; sums are combined on the map side."""
    return costed.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("cost_pico").isNull()).alias("unpriced"),
        F.coalesce(F.sum("cost_pico"), F.lit(0)).cast("decimal(38,0)").alias("cost_pico"),
    )
