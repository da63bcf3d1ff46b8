"""Which files of the log table hold a value at a place of their metadata: an inverted index for containment.

Terms are hashes of (path, value), see :mod:`callgauge.operators.containment`. A segment has a row for each (term, file), with
the times of the first and the last log that has it, sorted by term, so a lookup reads the row groups its terms lie in. A file
may hold a match if it has every term of what is asked, and then only between the latest of their first times and the earliest
of their last ones. Such files are read and decided by the metadata itself, so collisions cost reading and nothing else.

Files are known by their path below the table, which is never used again. What a segment says of files that are gone is
skipped; files no segment knows yet are read whole. So results are right whatever state the index is in: behind, broken off,
or after a replay or a compaction of the table; :func:`refresh` catches up. A segment is valid once its marker exists.
``MERGE`` segments of one level become one of the next. One writer per index. A reader that meets a merge fails and has to
read again.

A term in all files (the key of a third of all logs) has as many rows as there are files, no more; tasks combine their own
first. What the driver holds are names of files, as Spark does for a table it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from callgauge.operators import containment
from callgauge.schemas import LOG_TABLE
from callgauge.streaming import sink as files

MERGE = 8
#: Most files that are named one by one; beyond it the table is listed whole and the files are picked by a join.
MAX_PATHS = 10_000
#: Rows of a segment in one file.
PER_FILE = 20_000_000
#: The term every indexed file has.
KNOWN = 0
DONE = ".done"
POSTINGS = "term BIGINT, file STRING, first BIGINT, last BIGINT"
FILE = "_file"
TABLE = T.StructType([*LOG_TABLE.fields, T.StructField(files.BATCH, T.LongType())])


@dataclass(frozen=True)
class Segment:
    number: int
    level: int

    @property
    def marker(self) -> str:
        return f"{self.number}.{self.level}{DONE}"


@dataclass(frozen=True)
class Found:
    """Rows that match, how many files were read for them, how many of these for lack of an index, and how many there are."""

    rows: DataFrame
    files_read: int
    unindexed: int
    files: int


def segments(spark: SparkSession, index: str) -> list[Segment]:
    if not files.exists(spark, index):
        return []
    marks = [n.removesuffix(DONE).split(".") for n in files.names(spark, index) if n.endswith(DONE)]
    return sorted((Segment(int(number), int(level)) for number, level in marks), key=lambda s: s.number)


def _postings(spark: SparkSession, index: str, of: list[Segment]) -> DataFrame | None:
    paths = [f"{index}/{s.number}" for s in of]
    return spark.read.schema(POSTINGS).parquet(*paths) if paths else None


def _live(spark: SparkSession, sink: str) -> set[str]:
    """Files of the table, named from the batch on."""
    return _names(files.read(spark, sink, TABLE), f"/{files.BATCH}=") if files.exists(spark, sink) else set()


def _names(rows: DataFrame, after: str) -> set[str]:
    return {path.rsplit(after, 1)[1] for path in rows.inputFiles()}


def _known(spark: SparkSession, index: str) -> set[str]:
    held = _postings(spark, index, segments(spark, index))
    return set() if held is None else {r[0] for r in held.where(F.col("term") == KNOWN).select("file").distinct().collect()}


def _of_files(spark: SparkSession, sink: str, names: set[str], live: set[str]) -> DataFrame:
    """Rows of the files named, with ``_file``."""
    marker = f"/{files.BATCH}="
    name = F.substring_index("_metadata.file_path", marker, -1).alias(FILE)
    if len(names) <= MAX_PATHS:
        paths = [f"{sink}{marker}{n}" for n in sorted(names)]
        if not paths:
            return spark.createDataFrame([], T.StructType([*TABLE.fields, T.StructField(FILE, T.StringType())]))
        return spark.read.schema(TABLE).option("basePath", sink).parquet(*paths).select("*", name)
    rows = files.read(spark, sink, TABLE).select("*", name)
    if names == live:
        return rows
    return rows.join(spark.createDataFrame([(n,) for n in sorted(names)], f"{FILE} STRING"), FILE, "left_semi")


def _terms_of(rows: DataFrame) -> DataFrame:
    """(term, file, first, last) of rows with metadata, ``requested_at`` and ``_file``; every file has ``KNOWN``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[int, str], list] = {}
            spans = batch.groupby([FILE, "metadata"], sort=False, dropna=False)["at"].agg(["min", "max"])
            for (file, text), low, high in spans.itertuples():
                for term in containment.terms(containment.parse(text)) | {KNOWN}:
                    span = found.setdefault((term, file), [low, high])
                    span[0], span[1] = min(span[0], low), max(span[1], high)
            yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["term", "file", "first", "last"])

    read = rows.select(FILE, "metadata", F.unix_micros("requested_at").alias("at"))
    each = read.mapInPandas(run, POSTINGS)
    return each.groupBy("term", "file").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def _write(postings: DataFrame, index: str, segment: Segment) -> None:
    home = f"{index}/{segment.number}"
    ordered = postings.repartitionByRange("term", "file").sortWithinPartitions("term", "file")
    ordered.write.mode("overwrite").option("maxRecordsPerFile", PER_FILE).parquet(home)
    files.touch(postings.sparkSession, f"{index}/{segment.marker}")


def add(spark: SparkSession, sink: str, index: str, batch_id: int) -> None:
    """Adds a segment for one batch of the table. Reads nothing but that batch and what a merge takes up."""
    marker = f"{files.BATCH}={batch_id}"
    of_batch = {f"{batch_id}/{n}" for n in _names(spark.read.schema(LOG_TABLE).parquet(f"{sink}/{marker}"), f"/{marker}/")}
    if of_batch:
        _add(spark, sink, index, of_batch, of_batch)
        merge(spark, index)


def refresh(spark: SparkSession, sink: str, index: str) -> int:
    """Adds a segment for all files of the table that no segment knows; returns their number.

    If files are gone, as after a compaction, all segments become one without them.
    """
    live, known = _live(spark, sink), _known(spark, index)
    if new := live - known:
        _add(spark, sink, index, new, live)
    if known - live:
        held = segments(spark, index)
        _merge(spark, index, held, max(s.level for s in held), live)
    merge(spark, index)
    return len(new)


def _add(spark: SparkSession, sink: str, index: str, names: set[str], live: set[str]) -> None:
    number = max((s.number for s in segments(spark, index)), default=0) + 1
    _write(_terms_of(_of_files(spark, sink, names, live)), index, Segment(number, 0))


def merge(spark: SparkSession, index: str) -> None:
    """Brings the number of segments down."""
    while True:
        held = segments(spark, index)
        levels = [s.level for s in held]
        full = [n for n in sorted(set(levels)) if levels.count(n) >= MERGE]
        if not full:
            return
        _merge(spark, index, [s for s in held if s.level == full[0]], full[0] + 1)


def _merge(spark: SparkSession, index: str, old: list[Segment], level: int, live: set[str] | None = None) -> None:
    """One segment out of several. Rows that are there twice, as a merge that broke off leaves them, become one."""
    kept = _postings(spark, index, old)
    if live is not None:
        kept = kept.join(spark.createDataFrame([(n,) for n in sorted(live)], "file STRING"), "file", "left_semi")
    number = max(s.number for s in segments(spark, index)) + 1
    _write(kept.select("term", "file", "first", "last").distinct(), index, Segment(number, level))
    for s in old:
        files.delete(spark, f"{index}/{s.marker}")
    for s in old:
        files.delete(spark, f"{index}/{s.number}")


def lookup(spark: SparkSession, sink: str, index: str, part: str) -> Found:
    """Logs whose metadata contains ``part``, a JSON value as text.

    Files are picked by the index and read with a filter on their time; the metadata of what is left decides.
    """
    asked = sorted(containment.asked(containment.wanted(part)))
    live, known = _live(spark, sink), _known(spark, index)
    unindexed = live - known
    spans = {}
    held = _postings(spark, index, segments(spark, index))
    if held is not None:
        # rows of one (term, file) agree, so a segment that is there twice does no harm
        several = held.where(F.col("term").isin(asked)).groupBy("file").agg(
            F.count_distinct("term").alias("n"), F.max("first").alias("low"), F.min("last").alias("high")
        )
        may = several.where((F.col("n") == len(asked)) & (F.col("low") <= F.col("high"))).drop("n")
        spans = {r["file"]: (r["low"], r["high"]) for r in may.collect() if r["file"] in live}
    rows = _of_files(spark, sink, set(spans), live)
    if spans:
        # one range for all of them, in the column's own type, so that row groups are skipped by it
        low, high = min(s[0] for s in spans.values()), max(s[1] for s in spans.values())
        rows = rows.where(F.col("requested_at").between(F.timestamp_micros(F.lit(low)), F.timestamp_micros(F.lit(high))))
    if unindexed:
        rows = rows.unionByName(_of_files(spark, sink, unindexed, live))
    matching = rows.where(containment.json_contains("metadata", part)).drop(FILE)
    return Found(matching, len(spans) + len(unindexed), len(unindexed), len(live))
