"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's target is its weight's share of all words the mix may take, at most ``max_epochs`` times its own words. What
the capped sources leave is shared among the others by weight, again and again until none is above its cap. A document is
then taken ``floor(target / size of source)`` times whole, and the remaining part of an epoch goes to the documents that
come first in a seeded order, up to the one whose middle lies beyond what is left.

Only DataFrame operations. Totals are sums with map-side combination, so a source with any share of the rows is no
single task's work. The seeded order is a hash of the id; where it has to be cut is found by sums over 256 ranges of the
hash, then over 256 ranges of that one, and only the distinct ids and sizes of the last range (a 65,536th of a source's
ids) are put in order. Of rows with equal id and size only as many are taken once more as fit; they are numbered partition
by partition, so a source may be one repeated row.

Null texts have size 0. The null source is a source like any other, last in order. Rows with equal id and size rank in
any order and get equal results as a set. Documents of size 0 take nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from callgauge.llm.shared import fresh, keep

WEIGHTS, BUDGET, MAX_EPOCHS, SEED = (3, 1, 2), 1.5, 2, "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighted(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Gives sources (one row each) the weights in turn, by code point, null last.

    Sources may be many, so ranks are counted within ranges of the sorted names and added up over the ranges.
    """
    ranged = keep(
        totals.repartitionByRange(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    before = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1 + F.col("before")
    table = F.array(*[F.lit(w) for w in weights])
    return ranged.join(before, "part").select(
        "source", "source_size", F.get(table, F.pmod(rank, F.lit(len(weights))).cast("int")).alias("weight")
    )


def targets(sources: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) by water-filling; every round is one aggregate over the sources.

    The level only rises, so a capped source stays capped and the rounds end; each round caps at least one more.
    """
    cap = F.col("source_size") * max_epochs
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * budget
    level = 0.0
    while True:
        free = cap >= F.lit(level) * F.col("weight")
        taken, weight = sources.agg(F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight")))).first()
        raised = (total - (taken or 0)) / weight if weight else level
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def order_of(seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def placed(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds size and place in the seeded order to the documents' ids and sources."""
    return documents.select("doc_id", "source", words(F.col("text")).alias("size"), order_of(seed).alias("place"))


def plan(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Per source (``s``): its size and target, the whole repetitions, and where in the order the extra one ends."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = keep(targets(keep(weighted(totals, weights), "mix-weights"), budget, max_epochs), "mix-targets")
    aimed = aimed.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # ranges of the order that lie wholly before the cut, twice; then by id and size
    coarse, fine = F.substring("place", 1, 2), F.substring("place", 1, 4)
    first = _cut(rows.select("source", "size", coarse.alias("range")), aimed.select(F.col("source").alias("s"), "rest"))
    second = _cut(_inside(rows, first, coarse).select("source", "size", fine.alias("range")), first.select("s", "rest"))
    ties = _inside(rows, second, fine).groupBy("source", "place", "size").agg(F.count("*").alias("n"), F.first("rest").alias("rest"))
    end = F.sum(F.col("size") * F.col("n")).over(
        Window.partitionBy("source").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ties = ties.withColumn("before", end - F.col("size") * F.col("n"))
    fits = lambda i: (F.col("before") + i * F.col("size") - F.col("size") / 2 <= F.col("rest")).cast("long")
    near = F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5)  # off by one at most, by rounding
    take = F.greatest(F.lit(0), F.least(F.col("n"), near - 1 + fits(near) + fits(near + 1)))
    last = (
        ties.withColumn("take", take)
        .groupBy(F.col("source").alias("t"))
        .agg(
            F.max(F.when(F.col("take") == F.col("n"), F.struct("place", "size"))).alias("last"),
            F.max(F.when((F.col("take") > 0) & (F.col("take") < F.col("n")), F.struct("place", "size", "take"))).alias("tie"),
        )
    )
    cuts = second.select("s", "cut").join(last, F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
    planned = aimed.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")
    return keep(planned.withColumnRenamed("source", "s"), "mix-plan")


def repeated(rows: DataFrame, planned: DataFrame, size: Column, place: Column, names: list[str]) -> DataFrame:
    """Adds source_size, target, repeats and taken, under the names given (free ones), to rows that have a source."""
    key, has = fresh(rows, "plan_source"), fresh(rows, "plan")
    packed = planned.select(F.col("s").alias(key), F.struct(*[c for c in planned.columns if c != "s"]).alias(has))
    fine, cut = F.substring(place, 1, 4), F.col(has)["cut"]
    before = (fine < cut) | ((fine == cut) & (F.struct(place, size) <= F.col(has)["last"]))
    repeats = F.col(has)["whole"] + F.coalesce(before, F.lit(False)).cast("long")
    made = lambda repeats: [F.col(has)["source_size"], F.col(has)["target"], repeats, size * repeats]
    named = lambda df, repeats: df.select(*rows.columns, *[c.alias(name) for c, name in zip(made(repeats), names)])
    planned_for = F.col("source").eqNullSafe(F.col(key))
    if planned.where("tie is not null").isEmpty():
        return named(rows.join(packed, planned_for), repeats)
    tie = F.col(has)["tie"]
    split = F.coalesce((place == tie["place"]) & (size == tie["size"]), F.lit(False))
    part, n, rank, t, u = (fresh(rows, name) for name in ("plan_part", "plan_n", "plan_rank", "plan_t", "plan_u"))
    tied = keep(rows.withColumn(part, F.spark_partition_id()).join(packed, planned_for).where(split), "mix-ties")
    counts = tied.groupBy(F.col("source").alias(t), F.col(part).alias(u)).agg(F.count("*").alias(n))
    counts = counts.withColumn(n, F.sum(n).over(Window.partitionBy(t).orderBy(u)) - F.col(n))
    ranked = tied.withColumn(rank, F.row_number().over(Window.partitionBy("source", part).orderBy(part))).join(
        counts, F.col("source").eqNullSafe(F.col(t)) & (F.col(part) == F.col(u))
    )
    more = (F.col(rank) + F.col(n) <= tie["take"]).cast("long")
    return named(rows.join(packed, planned_for).where(~split), repeats).unionByName(named(ranked, F.col(has)["whole"] + more))


def mix(documents: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """(doc_id, source, size, place, source_size, target, repeats, taken) of every document; ``how`` goes to ``plan``."""
    rows = keep(placed(documents, seed), "mix")
    return repeated(rows, plan(rows, **how), F.col("size"), F.col("place"), ["source_size", "target", "repeats", "taken"])


def _inside(rows: DataFrame, cuts: DataFrame, level: Column) -> DataFrame:
    """Rows of the range in which their source is cut, with what is left for that range."""
    return rows.where("size > 0").join(cuts, F.col("source").eqNullSafe(F.col("s")) & (level == F.col("cut")))


def _cut(rows: DataFrame, left: DataFrame) -> DataFrame:
    """(s, cut, rest): per source the first range by whose end ``rest`` words are reached, and what is left for it."""
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    ends = sums.withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("range")))
    found = F.struct("range", (F.col("rest") - (F.col("end") - F.col("n"))).alias("rest"))
    return keep(
        ends.join(left, F.col("source").eqNullSafe(F.col("s")))
        .groupBy("s")
        # rounding of a target may leave a hair more than all ranges have: then the last one
        .agg(F.coalesce(F.min(F.when(F.col("end") >= F.col("rest"), found)), F.max(found)).alias("x"))
        .select("s", F.col("x.range").alias("cut"), F.col("x.rest").alias("rest")),
        "mix-cut",
    )
