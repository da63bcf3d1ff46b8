"""Which ids a table holds: Bloom filters in front of hash-bucketed files of ids.

Every batch adds a segment with its new ids; a segment's ids lie in buckets of up to ``PER_BUCKET`` by their hash, one file
and one filter each. To look a batch up, its ids are tested against the filters of the buckets they fall in. What a filter
denies is not there; only files some id may be in are read, and they decide by the ids themselves. A batch of new ids thus
reads hardly any file of ids, however many are stored, and its copies cost the files they hit.

``MERGE`` segments of one level become one of the next, so a table of n batches has at most ``MERGE * log(n)`` segments and
an id is rewritten ``log(n)`` times. A segment is valid once its marker exists, and not any more once a wider one is, so a
merge or a batch may break off anywhere. One writer per index; the current batch's segment is never merged, as the batch
may be run again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from callgauge.streaming import sink as files

PER_BUCKET = 1 << 20
MERGE = 8
#: About one in three million ids that are not there passes a filter.
BITS_PER_ID, PROBES = 32, 16
#: Most buckets of a lookup that are named one by one; beyond it whole segments' filters are read.
MAX_PATHS = 2_000
#: Ids of a batch that are tested by one task.
PER_TASK = 1 << 20
#: Ids a bucket has on average from which on no bucket can be empty (the odds are below 1 in 10 ** 40).
FULL = 100
#: Ids whose bits are worked out together; a bucket's would take hundreds of MB.
AT_ONCE = 1 << 14
DONE = ".done"
BLOOM = "last BIGINT, bucket BIGINT, bits BINARY"


@dataclass(frozen=True)
class Segment:
    """Ids of the batches ``first`` to ``last``, in ``2 ** bits`` buckets."""

    first: int
    last: int
    level: int
    bits: int
    n: int

    @property
    def name(self) -> str:
        return f"{self.first}-{self.last}"

    @property
    def marker(self) -> str:
        return f"{self.name}.{self.level}.{self.bits}.{self.n}{DONE}"

    def covers(self, other: Segment) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last


@dataclass(frozen=True)
class Lookup:
    """Ids that are known to be stored among candidates (null: none can be), and the files read to tell."""

    ids: DataFrame | None
    filters_read: int
    files_read: int


def segments(spark: SparkSession, index: str) -> list[Segment]:
    """The valid segments, oldest first."""
    done = _done(spark, index)
    return [s for s in done if not any(o.covers(s) for o in done)]


def _done(spark: SparkSession, index: str) -> list[Segment]:
    if not files.exists(spark, index):
        return []
    found = []
    for name in files.names(spark, index):
        if name.endswith(DONE):
            span, *numbers = name.removesuffix(DONE).split(".")
            first, last = span.split("-")
            found.append(Segment(int(first), int(last), *map(int, numbers)))
    return sorted(found, key=lambda s: (s.first, s.last))


def _read(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    """Folders of different depth; the bucket in their names is not read as a column."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("probe"), key).alias("b")]


def _bucket(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0).cast("long")


def _places(rows: pd.DataFrame, size: int) -> Iterator[np.ndarray]:
    """The bits of a filter of ``size`` that stand for each row, for ``AT_ONCE`` rows at a time."""
    for start in range(0, len(rows), AT_ONCE):
        a, b = (rows[c].iloc[start : start + AT_ONCE].to_numpy(np.int64).view(np.uint64) for c in ("a", "b"))
        yield (a[:, None] + np.arange(PROBES, dtype=np.uint64) * (b | np.uint64(1))[:, None]) % np.uint64(size)


def _filter(rows: pd.DataFrame) -> bytes:
    size = 8 * (len(rows) * BITS_PER_ID // 8 + 8)
    bits = np.zeros(size, bool)
    for place in _places(rows, size):
        bits[place] = True
    return np.packbits(bits).tobytes()


def _passes(rows: pd.DataFrame, bits: bytes) -> bool:
    known = np.frombuffer(bits, np.uint8)
    for place in _places(rows, len(known) * 8):
        if (known[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8) & 1).all(axis=1).any():
            return True
    return False


def add(ids: DataFrame, index: str, first: int, last: int, n: int, level: int = 0) -> Segment:
    """Writes a segment of ``n`` ids (the only column), each there once."""
    spark, key = ids.sparkSession, ids.columns[0]
    segment = Segment(first, last, level, max(0, math.ceil(math.log2(max(1, n) / PER_BUCKET))), n)
    home = f"{index}/{segment.name}"
    _remove(spark, index, [s for s in _done(spark, index) if s.name == segment.name])
    buckets = 1 << segment.bits
    placed = ids.select(F.col(key).alias("id"), _bucket(F.xxhash64(key), segment.bits).alias("bucket"))
    placed.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/ids")

    def filters(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = rows["bucket"].iloc[0]
        return pd.DataFrame({"last": [last], "bucket": [bucket], "bits": [_filter(rows[rows["a"].notna()])], "at": [bucket]})

    hashed = spark.read.schema("id STRING, bucket BIGINT").parquet(f"{home}/ids").select("bucket", *_hashes(F.col("id")))
    if n < FULL * buckets:
        # a bucket without ids has a filter too
        hashed = spark.range(buckets).withColumnRenamed("id", "bucket").join(hashed, "bucket", "left")
    made = hashed.groupBy("bucket").applyInPandas(filters, f"{BLOOM}, at BIGINT")
    made.write.mode("overwrite").partitionBy("at").parquet(f"{home}/filters")
    files.touch(spark, f"{index}/{segment.marker}")
    return segment


def lookup(spark: SparkSession, index: str, rows: DataFrame, key: str, n_rows: int, before: int) -> Lookup:
    """Stored ids of the batches before ``before`` that can be among ``rows`` (``n_rows`` of them, or fewer)."""
    known = [s for s in segments(spark, index) if s.last < before and s.n]
    if not known:
        return Lookup(None, 0, 0)
    hashed = rows.select(*_hashes(F.col(key)))
    paths = _filter_paths(hashed, known, index)
    spread = 1 + n_rows // PER_TASK
    each = F.array(*[F.struct(F.lit(s.last).cast("long").alias("last"), _bucket(F.col("a"), s.bits).alias("bucket")) for s in known])
    asked = hashed.withColumn("_at", F.explode(each)).select("_at.*", F.pmod("b", F.lit(spread)).alias("part"), "a", "b")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("part")
    filters = _read(spark, BLOOM, paths).select("*", parts)

    def tested(ids: pd.DataFrame, of_bucket: pd.DataFrame) -> pd.DataFrame:
        hit = len(ids) > 0 and len(of_bucket) > 0 and _passes(ids, of_bucket["bits"].iloc[0])
        return ids[["last", "bucket"]].head(1) if hit else ids[["last", "bucket"]].head(0)

    groups = [df.groupBy("last", "bucket", "part") for df in (asked, filters)]
    hits = groups[0].cogroup(groups[1]).applyInPandas(tested, "last BIGINT, bucket BIGINT").distinct().collect()
    if not hits:
        return Lookup(None, len(paths), 0)
    named = {s.last: s.name for s in known}
    found = [f"{index}/{named[h['last']]}/ids/bucket={h['bucket']}" for h in hits]
    return Lookup(_read(spark, "id STRING", found).withColumnRenamed("id", key), len(paths), len(found))


def _filter_paths(hashed: DataFrame, known: list[Segment], index: str) -> list[str]:
    widest = max(s.bits for s in known)
    touched = [0]
    if widest:
        touched = [r[0] for r in hashed.select(_bucket(F.col("a"), widest)).distinct().limit(MAX_PATHS + 1).collect()]
    paths = []
    for s in known:
        at = {t >> (widest - s.bits) for t in touched}
        if len(touched) > MAX_PATHS or len(at) == 1 << s.bits:
            paths.append(f"{index}/{s.name}/filters")
        else:
            paths += [f"{index}/{s.name}/filters/at={b}" for b in sorted(at)]
    return paths


def merge(spark: SparkSession, index: str, before: int) -> None:
    """Brings the number of segments down, those of batches from ``before`` on left alone."""
    while True:
        live = [s for s in segments(spark, index) if s.last < before]
        _remove(spark, index, [s for s in _done(spark, index) if any(o.covers(s) for o in live)])
        runs = [live[i : i + MERGE] for i in range(len(live) - MERGE + 1) if len({s.level for s in live[i : i + MERGE]}) == 1]
        if not runs:
            return
        old = min(runs, key=lambda run: run[0].level)
        ids = _read(spark, "id STRING", [f"{index}/{s.name}/ids" for s in old])
        add(ids, index, old[0].first, old[-1].last, sum(s.n for s in old), old[0].level + 1)


def cover(spark: SparkSession, index: str, sink: str, key: str, before: int) -> None:
    """Segments for stored batches the index does not know yet, as when a table was kept another way until now."""
    known = segments(spark, index)
    missing = [b for b in files.batches(spark, sink) if b < before and not any(s.first <= b <= s.last for s in known)]
    while missing:
        run = [b for b in missing if not any(missing[0] < s.first <= b for s in known)]
        ids = _read(spark, f"{key} STRING", [f"{sink}/{files.BATCH}={b}" for b in run])
        add(ids, index, run[0], run[-1], ids.count())
        missing = [b for b in missing if b > run[-1]]


def _remove(spark: SparkSession, index: str, old: list[Segment]) -> None:
    """Markers first: what has none is not read."""
    for segment in old:
        files.delete(spark, f"{index}/{segment.marker}")
    for name in {s.name for s in old}:
        if not any(s.name == name for s in _done(spark, index)):
            files.delete(spark, f"{index}/{name}")
