"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: A-Z lower-cased, words between ASCII white space, shingles of ``SHINGLE`` words joined by one space
(repeats count; a shorter text is one shingle), XXH64 with seed 42, and a bit set where over half the hashes have it.
Two fingerprints link when they differ in at most ``RADIUS`` bits.

Comparing every tile of fingerprints with every other is quadratic, so tiles are cut within blocks that lose no pair:
split the 64 bits in ``bands`` parts, and two fingerprints within the radius agree in at least ``bands - radius`` of
them. Blocks are the values of every such choice of parts; ``bands`` grows with the number of fingerprints, so blocks
stay small on average. A block that is large all the same (one key may hold any share of the rows) is cut into tiles of
at most about ``TILE`` fingerprints of one population count, and a pair of tiles is compared only if the counts differ by
no more than the radius, as the distance of two numbers is at least the difference of their bit counts. Pairs of tiles are
spread over the cluster. Inside a task numpy does the exclusive-or and counts bits; a task hands on a spanning forest of
its links instead of all pairs, which keeps every component.

Null and empty texts have fingerprint zero and link like any other. Rows with equal fingerprints are compared once. A null
id never names a component (a component of null ids only is named null). No row is lost or cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from callgauge.llm.shared import components, keep

SHINGLE, RADIUS, TILE = 4, 4, 2048
#: Mean number of fingerprints in a block from which on more bands are used.
BLOCK = 4096
SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = SPACE.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip(b" ")
    if not words:
        return 0
    data = np.frombuffer(words, np.uint8)
    gaps = np.nonzero(data == 32)[0]
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(words)]))
    if len(starts) > shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):  # bounded memory whatever the length
        a, b = starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist()
        hashes = np.array([digest(words[i:j], 42) for i, j in zip(a, b)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a signed long with the same bits."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], np.uint64).view(np.int64))

    return run(text)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def band_plan(count: int, radius: int = RADIUS) -> list[tuple[int, ...]]:
    """Masks of the bit groups two fingerprints within the radius must agree in one of, for about ``count`` of them."""
    for bands in range(radius + 1, 64):
        agree = bands - radius
        if count / 2.0 ** (64 * agree / bands) <= BLOCK or agree > 3:
            break
    edges = [64 * i // bands for i in range(bands + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(fingerprints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that connect all that are within the radius."""
    count = fingerprints.count()
    masks = F.array(*[F.lit(m) for m in band_plan(count, radius)])
    rows = fingerprints.select("fp", F.bit_count("fp").alias("ones"), F.posexplode(masks).alias("band", "mask")).select(
        "band", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "ones", "fp"
    )
    # sizes of the blocks, by population count: a row for each key and count at most
    by_ones = rows.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))
    blocks = (
        by_ones.groupBy("band", "value")
        .agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("ones", "n"))).alias("sizes"))
        .where("size > 1")
    )
    rows = rows.join(blocks, ["band", "value"])
    one = rows.where(F.col("size") <= tile).select("band", "value", F.lit(0).alias("pair"), F.lit(0).alias("side"), "fp")
    # tile numbers of a large block: population count and part; part by hash, so it needs no order
    parts_of = lambda ones: F.ceil(F.col("sizes")[ones] / F.lit(tile)).cast("int")
    own = F.col("ones") * 100_000 + F.pmod(F.xxhash64("fp"), parts_of(F.col("ones"))).cast("int")
    near = F.filter(F.map_keys("sizes"), lambda o: F.abs(o - F.col("ones")) <= radius)
    others = F.flatten(
        F.transform(near, lambda o: F.transform(F.sequence(F.lit(0), parts_of(o) - 1), lambda p: o * 100_000 + p))
    )
    many = (
        rows.where(F.col("size") > tile)
        .withColumn("own", own)
        .withColumn("other", F.explode(others))
        .select(
            "band",
            "value",
            F.xxhash64(F.least("own", "other"), F.greatest("own", "other")).alias("pair"),
            F.sign(F.col("own") - F.col("other")).cast("int").alias("side"),
            "fp",
        )
    )
    tiles = one.unionByName(many.withColumn("pair", F.col("pair").cast("long")))
    key = ["band", "value", "pair"]
    return tiles.repartition(*key).sortWithinPartitions(*key).mapInPandas(_compare(radius), "a long, b long").distinct()


def groups(documents: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS):
    """(id, text_hash, fp, label, component): fingerprint of each row, its component's label and smallest id.

    One pass over the texts; everything after it works on the fingerprints.
    """
    rows = keep(
        documents.select(
            F.col(row_id).alias("id"), F.xxhash64(text).alias("text_hash"), fingerprint(F.col(text), shingle).alias("fp")
        ),
        "simhash",
    )
    ids = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    linked = components(keep(links(ids.select("fp"), radius), "simhash-links"))
    named = ids.join(linked, ids["fp"] == linked["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("label"), "first_id"
    )
    named = keep(named, "simhash-labels")
    least = named.groupBy("label").agg(F.min("first_id").alias("component"))
    return rows.join(named.select("fp", "label").join(least, "label"), "fp")


def survivors(grouped: DataFrame) -> DataFrame:
    """(id, text_hash) of the one document that stays of each group: the smallest id, then the smallest text hash."""
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    return grouped.groupBy("label").agg(F.min(first).alias("first")).select("first.id", "first.text_hash")


def _compare(radius: int):
    """Runs of (band, value, pair) in sorted rows -> edges of a spanning forest of the links in each run."""

    def within(fps: np.ndarray, side: np.ndarray) -> Iterator[pd.DataFrame]:
        # a tile against itself has side 0 throughout; else -1 against 1
        left, right = (fps, fps) if (side == 0).all() else (fps[side < 0], fps[side > 0])
        everything = np.concatenate((left, right)) if left is not right else left
        offset = 0 if left is right else len(left)
        root = list(range(len(everything)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        step = max(1, (1 << 20) // max(1, len(right)))
        for at in range(0, len(left), step):
            close = np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= radius
            for i, j in zip(*(x.tolist() for x in np.nonzero(close))):
                a, b = find(at + i), find(offset + j)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((at + i, offset + j))
        if out:
            pairs = everything[np.array(out)].view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rows[["band", "value", "pair"]].to_numpy()
            cuts = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
            ends = cuts.tolist()  # the last run may go on in the next batch
            yield from spans(rows, ends)
            rest = rows.iloc[ends[-1] if ends else 0 :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from spans(rest, [len(rest)])

    def spans(rows: pd.DataFrame, ends: list[int]) -> Iterator[pd.DataFrame]:
        fps, side, start = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy(), 0
        for end in ends:
            if end - start > 1:
                yield from within(fps[start:end], side[start:end])
            start = end

    return run
