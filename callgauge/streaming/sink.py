"""Parquet folders written once per micro-batch.

Every batch owns the folder ``batch_id=N`` and overwrites it, so a batch that is replayed after a failure replaces what
the failed attempt left behind instead of adding to it. Old batches are merged by ``compact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BATCH = "batch_id"


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds."""
    return [s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path))]


def touch(spark: SparkSession, path: str) -> None:
    """Makes an empty file."""
    _fs(spark, path).create(_path(spark, path)).close()


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def write_batch(rows: DataFrame, batch_id: int, path: str, *partitions: str) -> None:
    writer = rows.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(f"{path}/{BATCH}={batch_id}")


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


STAGE = "_compacted"


def compact(
    spark: SparkSession, path: str, keep: int, schema: T.StructType, combine: Callable[[DataFrame], DataFrame], *partitions: str
) -> None:
    """Merges all but the last ``keep`` batches into the folder of the last of them. Single writer; rows stay the same.

    The merged rows are written beside the table first. From then on the step is finished by whoever comes next, so it
    may break off anywhere. While folders are exchanged, a reader may miss files and has to read again.
    """
    finish_compaction(spark, path)
    if not exists(spark, path):
        return
    numbers = batches(spark, path)
    old = numbers[: max(0, len(numbers) - keep)]
    if len(old) < 2:
        return
    fields = [f for f in schema.fields if f.name != BATCH]
    known = read(spark, path, T.StructType([*fields, T.StructField(BATCH, T.LongType())]))
    merged = combine(known.where(F.col(BATCH) <= old[-1]))
    write_batch(merged.drop(BATCH), old[-1], f"{path}/{STAGE}", *partitions)
    touch(spark, f"{path}/{STAGE}/_DONE")
    finish_compaction(spark, path)


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Puts merged rows in place of the batches they were made of; drops what was not finished."""
    stage = f"{path}/{STAGE}"
    if not exists(spark, stage):
        return
    fs = _fs(spark, path)
    if exists(spark, f"{stage}/_DONE"):
        for last in batches(spark, stage):
            for number in batches(spark, path):
                if number <= last:
                    fs.delete(_path(spark, f"{path}/{BATCH}={number}"), True)
            fs.rename(_path(spark, f"{stage}/{BATCH}={last}"), _path(spark, f"{path}/{BATCH}={last}"))
    fs.delete(_path(spark, stage), True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in names(spark, path) if n.startswith(f"{BATCH}="))


def newest(versions: DataFrame, *keys: str) -> DataFrame:
    """Current rows of a table whose batches hold the groups they changed: the version of the latest batch."""
    values = [c for c in versions.columns if c not in (*keys, BATCH)]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_row")).select(*keys, "_row.*")
