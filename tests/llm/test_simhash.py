import random
import re

import numpy as np
import pytest
import xxhash
from helpers import docs, union_find
from pyspark.sql import functions as F

from callgauge.llm import simhash


def plain(text):
    """Fingerprint straight from the contract."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, fps):
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS]
    root = union_find(len(fps), pairs)
    least = {}
    for r, row in zip(root, rows):
        if row[0] is not None:
            least[r] = min(least.get(r, row[0]), row[0])
    return [least.get(r) for r in root]


def check(spark, rows, **how):
    fps = [plain(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], fps, expected(rows, fps)), key=repr)
    got = simhash.groups(docs(spark, rows, ["fp", "component", "label", "id"]), **how).select("id", "fp", "component").collect()
    assert sorted(((r.id, r.fp & (2**64 - 1), r.component) for r in got), key=repr) == want


def test_against_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(5, None), (4, ""), (9, " \t\n"), (None, "a b c d e"), (None, "A b c\nd  e"), (7, "a"), (7, "a"), (1, "é ñ ÄB ä"), (3, long), (2, long + " x"), (8, "\x0b\x85  ")]
    check(spark, rows)


def test_empty(spark):
    assert simhash.groups(docs(spark, [])).count() == 0


def test_masks_lose_no_pair():
    draw = random.Random(1)
    for count in (10, 10**7, 10**9, 10**12):
        masks = [m & (2**64 - 1) for m in simhash.band_plan(count)]
        for _ in range(300):
            a = draw.getrandbits(64)
            b = a
            for bit in draw.sample(range(64), simhash.RADIUS):
                b ^= 1 << bit
            assert any((a ^ b) & m == 0 for m in masks)


@pytest.mark.parametrize("tile", [3, 16, 2048])
def test_large_blocks_are_tiled(spark, tile):
    """Many fingerprints around one value and a few far ones: blocks far larger than a tile."""
    draw = random.Random(tile)
    fps = {0}
    for _ in range(150):
        base = draw.choice(sorted(fps))
        fps.add(base ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    fps |= {draw.getrandbits(64) for _ in range(30)}
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in np.array(fps, np.uint64).view(np.int64).tolist()], "fp long")
    index = {x: i for i, x in enumerate(fps)}
    edges = simhash.links(df, tile=tile).collect()
    pairs = [(index[r.a & (2**64 - 1)], index[r.b & (2**64 - 1)]) for r in edges]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in pairs)
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert union_find(len(fps), pairs) == union_find(len(fps), want)


def test_one_survivor_of_each_group(spark):
    rows = [(3, "same text of some words"), (2, "same text of some words"), (None, "same text of some words"), (None, "other"), (6, ""), (5, None)]
    got = simhash.survivors(simhash.groups(docs(spark, rows))).select("id").collect()
    assert sorted((r.id for r in got), key=repr) == [2, 5, None]


def test_hex(spark):
    df = spark.createDataFrame([(0,), (-1,), (255,)], "fp long").select(simhash.as_hex(F.col("fp")).alias("h"))
    assert [r.h for r in df.collect()] == ["0" * 16, "f" * 16, "00000000000000ff"]
