"""What several operators need: tables cut off from their lineage, column names that are free, connected components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from callgauge.session import scratch_dir


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared scratch folder and reads it back, so that a lost executor costs no recomputation."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Removes the files of a table that ``keep`` has written and nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of the table has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pieces(texts: list[str | None], most: int = 1_000_000) -> Iterator[list[str]]:
    """A batch of texts in pieces of about ``most`` characters (a longer text is one by itself), null as empty text.

    What a task holds besides the batch it was given then follows the piece, however many rows a batch has.
    """
    piece: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if piece and size + len(text) > most:
            yield piece
            piece, size = [], 0
        piece.append(text)
        size += len(text) + 1
    if piece:
        yield piece


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(row_id: str, text: str) -> list[Column]:
    """What tells rows apart: the id and a hash of the text. Rows that agree in both get equal results everywhere."""
    return [F.col(row_id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash")]


def matching(df: DataFrame, keys: DataFrame, row_id: str, text: str, how: str) -> DataFrame:
    """Rows of ``df`` (all columns) that are in ``keys`` (id, text_hash; how="left_semi") or not in it ("left_anti")."""
    named = fresh(df, "text_hash")
    tagged = df.withColumn(named, F.xxhash64(F.col(text)))
    on = tagged[row_id].eqNullSafe(keys["id"]) & (tagged[named] == keys["text_hash"])
    return tagged.join(keys, on, how).drop(named)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b): one row (node, component) for every node, named by the smallest node it reaches.

    Alternates the large-star and the small-star step (Kiveris et al., Connected Components in MapReduce and Beyond)
    until no edge changes. Neighbours are reduced to their minimum before anything is gathered, so a node with any
    number of neighbours takes no more memory than another, and each round is written out, so lineage stays short.
    """
    spark: SparkSession = edges.sparkSession
    now = keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges."""
    hashed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(hashed), F.sum(F.shiftright(hashed, 16))).first())
