"""A Merkle manifest of a dataset: every row gets its proof by a butterfly exchange.

Leaves are numbered within their group. ``fanout ** depth`` consecutive ones are a block, which hashes its own subtree.
Then blocks swap digests, round by round: in round r the blocks of an aligned run of ``fanout ** (r + 1)`` that agree in all
digits of their number but the r-th meet, each with the root of the subtree it belongs to. Every one of them hashes the
same parent, redundantly, and keeps what the others brought as its own proof. After as many rounds as the number of blocks
has digits each block knows the group's root and the upper part of its leaves' proofs, without a pass back down. No more
than ``fanout`` digests ever meet. A last, ragged subtree has too few blocks to meet everyone, so its blocks go to several
places. The groups' roots are the leaves of one more tree, built the same way.

A node of one run is the hash of its children's digests as hexadecimal text; while several nodes remain, a last run of one
is hashed as well. A group of one leaf has that leaf for its root.

Groups and orders may be of any size: numbering sorts by range, with rows that agree in everything spread as well, and a
task holds the siblings of one run. Null groups come first, null orders first within a group; rows with equal order go by
their digest, so equal rows may swap places and the proofs as a whole stay the same. A group text counts by its UTF-8 bytes.
An empty table gives no rows. Very long values are hashed as they stand; only digests are moved.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from callgauge.llm.shared import keep

FANOUT, DEPTH = 16, 3
#: What a leaf is the hash of.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PLACE_BITS = 33  # of monotonically_increasing_id


def leaf(*values: Column) -> Column:
    """Hash of a row's values: byte count, colon and value of each, a dash for null."""
    texts = [v.cast("string") for v in values]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*told), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` (kept in files) with ``pos``, counting from 0 within the group, and ``n``, the rows of the group.

    Rows are sorted by range of (group, order), so a large group lies in many partitions. A row's place in its partition
    and the rows of its group in the partitions before give its number.
    """
    at = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    ranged = rows.withColumn("_tie", at).repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
    placed = keep(ranged.drop("_tie").withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_place", PLACE_BITS).alias("_part")
    parts = placed.groupBy(group, part).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("_rows").over(W.partitionBy(group))
    shift = (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")
    # a row per partition and group in it
    shifts = parts.select(group, "_part", shift, total.alias("n"))
    joined = placed.select("*", part).join(shifts, [group, "_part"])
    return joined.withColumn("pos", F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def _met(over: WindowSpec | None = None) -> Column:
    """The nodes of a run in order, as an aggregate or over a window."""
    listed = F.collect_list(F.struct("at", "digest"))
    return F.array_sort(listed if over is None else listed.over(over))


def _joined(met: Column) -> Column:
    return F.array_join(F.transform(met, lambda m: m["digest"]), "")


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next level of nodes (group, at, n, digest), ``n`` being the nodes of the group on its level; a root stays."""
    runs = nodes.groupBy("group", F.expr(f"at div {fanout}L").alias("at")).agg(F.max("n").alias("_n"), _met().alias("_met"))
    return runs.select(
        "group",
        "at",
        F.expr(f"(_n + {fanout - 1}L) div {fanout}L").alias("n"),
        F.when(F.col("_n") > 1, F.sha2(_joined(F.col("_met")), 256)).otherwise(F.col("_met")[0]["digest"]).alias("digest"),
    )


def levels(leaves: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """The nodes of the blocks by level, leaves first; the last one holds a node per block."""
    out = [leaves.select("group", F.col("pos").alias("at"), "n", "digest")]
    for _ in range(depth):
        out.append(parents(out[-1], fanout))
    return out


def _below(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with (left, right) of their run put in front of the ``path`` of their parents ``above``."""
    run = nodes.withColumn("_run", F.expr(f"at div {fanout}L"))
    met = _met(W.partitionBy("group", "_run"))
    side = lambda keep_it: _joined(F.filter("_met", keep_it))
    left, right = side(lambda m: m["at"] < F.col("at")), side(lambda m: m["at"] > F.col("at"))
    told = run.withColumn("_met", met).withColumn("_own", F.struct(left.alias("left"), right.alias("right"))).drop("_met")
    both = told.join(above.withColumnRenamed("at", "_run"), ["group", "_run"])
    path = F.when(F.col("n") > 1, F.concat(F.array("_own"), "path")).otherwise(F.col("path"))
    return both.withColumn("path", path).drop("_run", "_own")


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def exchange(blocks: DataFrame, fanout: int) -> DataFrame:
    """The butterfly over ``blocks`` (group, block, n_blocks, digest): each block's ``digest`` becomes its group's root,
    and ``path`` holds (left, right) per round."""
    now = blocks.withColumn("path", F.expr("cast(array() as array<struct<left:string,right:string>>)"))
    widest = blocks.agg(F.max("n_blocks")).first()[0] or 1
    stride = 1
    while stride < widest:
        now = keep(_round(now, stride, fanout), "round")
        stride *= fanout
    return now


def _round(now: DataFrame, stride: int, fanout: int) -> DataFrame:
    """Blocks whose subtrees of ``stride`` blocks are complete learn the next larger one."""
    subtree_no = F.expr(f"block div {stride}L")
    members = F.least(F.lit(stride).cast("long"), F.col("n_blocks") - subtree_no * stride)
    low = F.col("block") % stride
    # a block of a ragged subtree stands in for those that are missing; a whole subtree's goes to its own place only
    places = F.when(F.col("n_blocks") > stride, F.sequence(low, F.lit(stride - 1).cast("long"), members)).otherwise(F.array(low))
    sent = now.select(
        "*", subtree_no.alias("_subtree"), F.expr(f"block div {stride * fanout}L").alias("_run"), F.explode(places).alias("_low")
    )
    met = W.partitionBy("group", "_run", "_low")
    brought = F.array_sort(F.collect_list(F.struct("_subtree", "digest")).over(met))
    side = lambda keep_it: F.array_join(F.transform(F.filter("_met", keep_it), lambda m: m["digest"]), "")
    seen = sent.withColumn("_met", brought).where(F.col("_low") == F.col("block") % stride)
    left, right = side(lambda m: m["_subtree"] < F.col("_subtree")), side(lambda m: m["_subtree"] > F.col("_subtree"))
    more = F.col("n_blocks") > stride
    parted = seen.select("group", "block", "n_blocks", "digest", "path", left.alias("_left"), right.alias("_right"))
    return parted.select(
        "group",
        "block",
        "n_blocks",
        F.when(more, F.sha2(F.concat("_left", "digest", "_right"), 256)).otherwise(F.col("digest")).alias("digest"),
        F.when(more, F.concat("path", F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))))
        .otherwise(F.col("path"))
        .alias("path"),
    )


def upper(leaves: DataFrame, fanout: int, depth: int) -> DataFrame:
    """(group, block, digest, path) for every block of numbered leaves: its group's root and the way there."""

    tops = levels(leaves, fanout, depth)[-1].select("group", F.col("at").alias("block"), "digest")
    sizes = leaves.groupBy("group").agg(F.max("n").alias("n"))
    tops = tops.join(sizes, "group")
    size = fanout**depth
    return exchange(keep(tops.selectExpr("group", "block", f"(n + {size - 1}L) div {size}L as n_blocks", "digest"), "tops"), fanout)


def manifest(
    rows: DataFrame,
    group: str,
    order: str,
    digest: Column,
    claimed: Column | None = None,
    with_siblings: bool = True,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> DataFrame:
    """Per row: ``group`` (as text), ``order``, leaf, subroot, root, proof_sha256 and folded_root.

    ``digest`` is the leaf's hash (:func:`leaf`). ``siblings``, unless left out, holds the digests left and right of the way
    up, level by level; ``proof_sha256`` is the hash of them all. ``folded_root`` is what the leaf and the siblings give;
    where ``claimed`` is not null, it takes the place of the leaf there.
    """
    hidden = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    made = rows.select(
        hidden.alias("group"),
        F.col(order).alias("order"),
        digest.alias("digest"),
        (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"),
    )
    size = fanout**depth
    blocked = lambda df: df.withColumn("block", F.expr(f"pos div {size}L"))
    leaves = keep(blocked(numbered(keep(made, "leaves"), "group", "order", "digest")), "numbered")
    way = keep(upper(leaves, fanout, depth), "upper")

    # the groups' roots, in order, are the leaves of the last tree; every block already knows its own group's
    tops = keep(way.where("block = 0").select(F.lit("").alias("group"), F.col("group").alias("order"), "digest"), "subroots")
    top_leaves = keep(blocked(numbered(tops, "group", "order")), "subroots")
    top_way = upper(top_leaves, fanout, depth).select(F.col("group"), "block", F.col("digest").alias("root"), "path")
    unclaimed = top_leaves.withColumn("claimed", F.lit(None).cast("string"))
    named = _finish(unclaimed, top_way.withColumn("subroot", F.col("root")), True, fanout, depth)
    named = named.select(F.col("order").alias("group"), "root", F.col("siblings").alias("_top"))
    way = way.withColumnRenamed("digest", "subroot").join(named, "group")
    way = way.select("group", "block", "subroot", "root", F.concat("path", "_top").alias("path"))
    done = _finish(leaves, way, with_siblings, fanout, depth)
    names = [F.when(F.col("group") != "", F.expr("substring(group, 2)")).alias(group), F.col("order").alias(order)]
    return done.select(*names, *done.columns[2:])


def _finish(leaves: DataFrame, way: DataFrame, with_siblings: bool, fanout: int, depth: int) -> DataFrame:
    """Every leaf's siblings: those in its block, then its block's way up."""
    above = way.select("group", F.col("block").alias("at"), "subroot", "root", "path")
    for nodes in levels(leaves, fanout, depth)[depth - 1 : 0 : -1]:
        above = _below(nodes, above, fanout).select("group", "at", "subroot", "root", "path")
    named = leaves.select("group", "order", F.col("pos").alias("at"), "n", "digest", "claimed")
    done = _below(named, above, fanout)
    folded = F.aggregate(
        "path", F.coalesce("claimed", "digest"), lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256)
    )
    whole = F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), "")
    columns = ["group", "order", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(whole, 256).alias("proof_sha256")]
    columns.append(folded.alias("folded_root"))
    if with_siblings:
        columns.append(F.col("path").alias("siblings"))
    return done.select(*columns)
