import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from callgauge.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://www.Example.com/a?x=1", "one"),
    (2, "http://www.example.com/b", "one"),
    (3, None, None),
    (4, "https://example.com", ""),
    (None, "http://x.org/\n y", "one"),
    (5, "http://ünï.org/ß", "zwei ☃"),
    (5, "http://ünï.org/ß", "zwei ☃"),
    (6, "no scheme", "long " * 50_000),
    (2**62 + 1, "http://big.org/", "same"),
    (2**62 + 3, "http://big.org/", "same"),
]


def keys(pages):
    return pages.select(warc.url_key(F.col("url")).alias("key"), F.col("page_id").alias("id"))


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "'x' as key", "1 as digest", "2 as payload")
    files = warc.write(pages)
    got = warc.lookup(keys(pages), files).collect()
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    want = [(i, len((h or "").encode()), digest(h)) for i, _, h in ROWS]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=repr) == sorted(want, key=repr)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr)
    assert kinds == sorted(
        [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "revisit", 2)]
        + [(5, "response", None)] * 2 + [(6, "response", None)]
        + [(2**62 + 1, "revisit", 2**62 + 3), (2**62 + 3, "response", None)],
        key=repr,
    )


def test_small_payloads_are_not_folded(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    got = warc.lookup(keys(pages), warc.write(pages, least_bytes=5)).collect()
    assert {r.record_type for r in got} == {"response"}


def test_many_blocks_and_missing_keys(spark):
    rows = [(i, f"http://h{i % 3}.example.com/{i // 5}", f"page {i}") for i in range(4000)]
    rows += [(i, "http://hot.example.com/", f"hot {i}") for i in range(4000, 7000)]
    pages = spark.createDataFrame(rows, PAGES)
    files = warc.write(pages)
    assert files.agg(F.sum("records")).first()[0] == 7000
    some = [(rows[i][1], i) for i in range(0, 7000, 97)] + [("http://h0.example.com/0", 777_777), ("http://zz.zz/", 1), ("", -5)]
    wanted = spark.createDataFrame(some, "url string, page_id long")
    got = warc.lookup(keys(wanted).unionByName(keys(wanted)), files).collect()
    assert sorted(r.page_id for r in got) == list(range(0, 7000, 97))


def test_archives_are_valid(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    warc.write(pages, f"file://{tmp_path}/w")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("w/*.warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == len(ROWS)
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        length = next(int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))
        assert rest[length : length + 4] == b"\r\n\r\n"
        data = rest[length + 4 :]


def test_urls_with_characters_that_end_lines_elsewhere(spark):
    rows = [(i, f"http://x.org/a{c}b", f"page {i}") for i, c in enumerate("\x85\u2028\u2029\x0b\x1c\r\n")]
    pages = spark.createDataFrame(rows, PAGES)
    assert sorted(r.page_id for r in warc.lookup(keys(pages), warc.write(pages)).collect()) == list(range(len(rows)))


def test_empty(spark):
    pages = spark.createDataFrame([], PAGES)
    assert warc.lookup(keys(pages), warc.write(pages)).count() == 0


def test_many_archives_and_nodes(spark, monkeypatch):
    monkeypatch.setattr(warc, "NODE", 3)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 400)
    rows = [(i, f"http://h{i % 7}.example.com/{i // 3}", f"page {i} " * 4) for i in range(500)]
    rows += [(None, None, None), (501, "", ""), (502, "http://h1.example.com/0", "long " * 20_000)]
    pages = spark.createDataFrame(rows, PAGES)
    files = warc.write(pages)
    assert files.count() > 40 and files.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.lookup(keys(pages), files).collect()
    assert sorted(((r.page_id, r.payload_bytes) for r in got), key=repr) == sorted(((i, len(h or "")) for i, _, h in rows), key=repr)
    asked = spark.createDataFrame([("http://a/", 1), ("http://zz.zz/", 1)], "url string, page_id long")
    assert warc.lookup(keys(asked), files).count() == 0
