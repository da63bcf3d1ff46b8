"""WARC archives with a two-level capture index.

``write`` sorts captures by reversed-host URL key and id, over ranges, so a host with any share of the captures is spread.
Each task streams its range into one archive (a gzip member per record) and one index file: the index entries, sorted by
key, in gzip blocks of ``BLOCK`` entries, and behind them a sparse directory with the first key, offset and length of each
block. The returned table, a row per file, is the level above. There are as many archives as the payloads' bytes ask for
(``ARCHIVE_BYTES``). Equal payloads are stored once: the capture with the largest
id is the response, the others are revisits that refer to it.

``lookup`` takes (key, id) pairs, sorted by range. The table of files goes into sorted node files of up to ``NODE`` rows, and
the driver and all tasks hold a row for each of these only. A task finds the node by binary search among them, the file by
binary search in the node, the block by binary search in the file's directory, reads that byte range, finds the entry by binary search in the block, and reads the byte
range of the record. Blocks stay in hand between neighbouring keys.

Files go to the shared folder through ``pyarrow.fs``, under names with the task attempt in them. A repeated attempt writes
other files, and only those of the attempt that Spark commits are in the table.

Null payloads count as empty. A null URL has the empty key, a null id sorts first and never is the one referred to (equal
payloads that all have null ids are all responses). Rows that share the largest id are all responses. Payloads shorter
than ``least_bytes`` are all responses. Equal captures are stored, and found, as often as they occur. A very long payload is one record,
held whole by its task; an archive that gets several is longer for it. An empty table gives no files and nothing is found.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import math
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from callgauge.llm.shared import keep
from callgauge.session import scratch_dir

BLOCK = 512
LEVEL = 4
#: Payload bytes of an archive, about, before compression.
ARCHIVE_BYTES = 1 << 30
#: Files of a node; a node is about 1 MB.
NODE = 4_096
LOW = -(1 << 63)
FILES = "first_key string, first_id long, archive string, index string, records long"
NODES = "first_key string, first_id long, node string"
FOUND = "page_id long, key string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """Host labels reversed and comma-joined, ``)``, then the rest: neighbours in a site are neighbours in the index."""
    host = F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(url, r"^[^:/?#]*://[^/?#]*", ""), r"[\x00-\x20]", "%")
    named = F.array_join(F.reverse(F.split(F.regexp_replace(F.lower(host), r"[\x00-\x20]", "%"), r"\.")), ",")
    return F.coalesce(F.concat(named, F.lit(")"), rest), F.lit(""))


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds key, payload, digest and the id a revisit refers to. Only digests that occur again are joined."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("id"),
        "url",
        url_key(F.col("url")).alias("key"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    again = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("id").alias("winner"), F.count("*").alias("n"))
        .where("n > 1 and winner is not null")
        .select("digest", "winner")
    )
    # as a stored table its size is known, so Spark broadcasts it where it is small and moves no payloads for it
    joined = rows.join(keep(again, "warc-equal"), "digest", "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("winner")), F.col("winner"))
    # ids pass through pandas as text: next to a null, large numbers would lose digits
    return joined.select("key", "id", "url", "digest", refers.cast("string").alias("refers_to"), "payload")


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes all captures and returns the table of files (see ``FILES``)."""
    folder = folder or scratch_dir(pages.sparkSession, "warc")
    size = pages.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    archives = max(pages.sparkSession.sparkContext.defaultParallelism, math.ceil(size / ARCHIVE_BYTES))
    rows = captures(pages, least_bytes).repartitionByRange(archives, "key", "id").sortWithinPartitions("key", "id")
    rows = rows.withColumn("id", F.col("id").cast("string"))
    return keep(rows.mapInPandas(_writer(folder, date), FILES), "warc-files")


def lookup(queries: DataFrame, files: DataFrame) -> DataFrame:
    """Captures of the distinct (key, id) pairs in ``queries``, read from the archives (see ``FOUND``)."""
    spark = queries.sparkSession
    folder = scratch_dir(spark, "warc-nodes")
    ordered = files.repartitionByRange("first_key", "first_id").sortWithinPartitions("first_key", "first_id")
    nodes = ordered.withColumn("first_id", F.col("first_id").cast("string")).mapInPandas(_node_writer(folder), NODES)
    # committed before it is read, so only nodes of attempts that succeeded are named; a row for 4,096 files
    top = sorted((r[0].encode(), LOW if r[1] is None else r[1], r[2]) for r in keep(nodes, "warc-top").collect())
    n_files = files.count()
    # keys are small and what they lead to is not: as many tasks as files, whatever the keys' size
    pairs = queries.select("key", "id").distinct().repartitionByRange(max(1, n_files), "key", "id")
    pairs = pairs.sortWithinPartitions("key", "id").withColumn("id", F.col("id").cast("string"))
    found = pairs.mapInPandas(_reader(top), FOUND.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string"))
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def _member(url: str | None, page: int | None, refers: int | None, digest: str, payload: bytes, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, with the length of the payload it leaves out."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers is None:
        block += payload
    else:
        lines.append(f"WARC-Refers-To: <urn:page:{refers}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """WARC header, block, HTTP header and payload of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, block, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _number(urn: str) -> str | None:
    return re.fullmatch(r"<urn:page:(-?\d*)>", urn)[1] or None


def _writer(folder: str, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name, archive, index = None, None, None
        entries: list[str] = []
        directory: list[tuple[str, int, int, int]] = []
        at = where = records = 0

        def flush() -> None:
            nonlocal where
            data = gzip.compress("".join(entries).encode(), LEVEL, mtime=0)
            key, page = entries[0].split("\t")[:2]
            directory.append((key, int(page) if page else LOW, where, len(data)))
            index.write(data)
            where += len(data)
            entries.clear()

        for rows in batches:
            ids = [None if pd.isna(i) else int(i) for i in rows["id"]]
            refers = [None if pd.isna(i) else int(i) for i in rows["refers_to"]]
            for key, page, url, digest, refer, payload in zip(
                rows["key"], ids, rows["url"], rows["digest"], refers, rows["payload"]
            ):
                if name is None:
                    task = TaskContext.get()
                    fs, path = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(path, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
                    archive = fs.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
                    index = fs.open_output_stream(f"{path}/{name}.index", compression=None)
                    start = (key, page)
                data = _member(url, page, refer, base64.b32encode(bytes.fromhex(digest)).decode(), payload, date)
                archive.write(data)
                entries.append(f"{key}\t{'' if page is None else page}\t{at}\t{len(data)}\n")
                at += len(data)
                records += 1
                if len(entries) == BLOCK:
                    flush()
        if name is None:
            return
        if entries:
            flush()
        tail = gzip.compress(json.dumps(directory).encode(), LEVEL, mtime=0)
        index.write(tail + len(tail).to_bytes(8, "big"))
        archive.close()
        index.close()
        yield pd.DataFrame(
            {
                "first_key": [start[0]],
                "first_id": pd.array([start[1]], dtype="Int64"),
                "archive": [f"{folder}/{name}.warc.gz"],
                "index": [f"{folder}/{name}.index"],
                "records": [records],
            }
        )

    return run


def _node_writer(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        n = 0
        for rows in batches:
            for at in range(0, len(rows), NODE):
                part = rows.iloc[at : at + NODE]
                ids = [None if pd.isna(i) else int(i) for i in part["first_id"]]
                listed = list(zip(part["first_key"], [LOW if i is None else i for i in ids], part["archive"], part["index"]))
                name = f"node-{task.partitionId():06d}-{task.taskAttemptId()}-{n}"
                with fs.open_output_stream(f"{path}/{name}.gz", compression="gzip") as out:
                    out.write(json.dumps(listed).encode())
                n += 1
                yield pd.DataFrame(
                    {"first_key": [listed[0][0]], "first_id": pd.array(ids[:1], dtype="Int64"), "node": [f"{folder}/{name}.gz"]}
                )

    return run


class _Node:
    """A sorted part of the table of files."""

    def __init__(self, node: str):
        fs, path = pafs.FileSystem.from_uri(node)
        with fs.open_input_stream(path, compression="gzip") as held:
            rows = json.loads(held.read())
        self.firsts = [(key.encode(), page) for key, page, _, _ in rows]
        self.files = [(archive, index) for _, _, archive, index in rows]


class _Index:
    """An archive and its index file, open for range reads."""

    def __init__(self, archive: str, index: str):
        fs, path = pafs.FileSystem.from_uri(index)
        self.index = fs.open_input_file(path)
        size = self.index.size()
        length = int.from_bytes(self._range(self.index, size - 8, 8), "big")
        self.blocks = json.loads(gzip.decompress(self._range(self.index, size - 8 - length, length)))
        self.firsts = [(key.encode(), page) for key, page, _, _ in self.blocks]
        self.archive = fs.open_input_file(pafs.FileSystem.from_uri(archive)[1])
        self.held: tuple[int, list, list] = (-1, [], [])

    @staticmethod
    def _range(file, offset: int, length: int) -> bytes:
        file.seek(offset)
        return file.read(length)

    def block(self, number: int) -> tuple[list, list]:
        if self.held[0] != number:
            _, _, offset, length = self.blocks[number]
            lines = gzip.decompress(self._range(self.index, offset, length)).decode().split("\n")[:-1]
            entries = [line.split("\t") for line in lines]
            self.held = (number, [(e[0].encode(), int(e[1]) if e[1] else LOW) for e in entries], entries)
        return self.held[1:]

    def find(self, wanted: tuple[bytes, int]) -> Iterator[bytes]:
        """The records of a (key, id); equal ones may go over several blocks."""
        number = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while number < len(self.firsts) and self.firsts[number] <= wanted:
            keys, entries = self.block(number)
            for i in range(bisect.bisect_left(keys, wanted), bisect.bisect_right(keys, wanted)):
                yield self._range(self.archive, int(entries[i][2]), int(entries[i][3]))
            number += 1

    def close(self) -> None:
        self.index.close()
        self.archive.close()


def _reader(top: list[tuple[bytes, int, str]]):
    firsts = [(key, page) for key, page, _ in top]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, node, number, file = -1, None, -1, None
        for rows in batches:
            out = []
            for key, page in zip(rows["key"], [LOW if pd.isna(i) else int(i) for i in rows["id"]]):
                wanted = (key.encode(), page)
                home = bisect.bisect_right(firsts, wanted) - 1
                if home < 0:
                    continue
                if home != at:
                    at, node, number = home, _Node(top[home][2]), -1
                # not before the first of the node, which is the first of its files
                home = bisect.bisect_right(node.firsts, wanted) - 1
                if home != number:
                    if file:
                        file.close()
                    number, file = home, _Index(*node.files[home])
                for member in file.find(wanted):
                    warc, _, http, payload = parse(member)
                    kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response":
                        real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if real != digest or len(payload) != int(http["Content-Length"]):
                            raise OSError(f"record of {warc['WARC-Record-ID']} is damaged")
                    refers = _number(warc["WARC-Refers-To"]) if kind == "revisit" else None
                    out.append(
                        (_number(warc["WARC-Record-ID"]), key, int(http["Content-Length"]), digest, kind, refers)
                    )
            yield pd.DataFrame(out, columns=["page_id", "key", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file:
            file.close()

    return run
