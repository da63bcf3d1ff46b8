"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that may be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a repeated JSON key keeps its last value instead of making the text unparseable
    "spark.sql.variant.allowDuplicateKeys": "true",
    # state of the streaming jobs may outgrow the heap
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("callgauge")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders made under the shared one.
_made: list[str] = []


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on (the time zone) and switch adaptive execution on.

    A local session that kept the default number of shuffle partitions gets as many as it has threads: streams do not
    coalesce them, and each one is a state store. A cluster's number is left alone.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    if is_local(spark) and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only a local session, whose executors share the
    driver's disk, may fall back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        _made.append(f"{shared.rstrip('/')}/callgauge/{name}-{uuid.uuid4().hex}")
        return _made[-1]
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    home = tempfile.mkdtemp(prefix="callgauge-")
    atexit.register(shutil.rmtree, home, ignore_errors=True)
    return os.path.join(home, name)


def clear_scratch(spark: SparkSession) -> None:
    """Removes what this process has put in the shared folder, for when none of its results is read any more."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
