import hashlib
import random
import zlib

import pytest
from helpers import docs
from pyspark.sql import functions as F

from callgauge.llm import merkle, queries

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_tree(digests, fanout):
    """Root, and left and right siblings of each leaf level by level, one node at a time."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, k in enumerate(at):
            low = k - k % fanout
            paths[i].append(("".join(level[low:k]), "".join(level[k + 1 : low + fanout])))
            at[i] = k // fanout
        level = [H("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain(rows, fanout=16):
    """(doc_id, leaf, subroot, root, proof, path) of (doc_id, source, leaf)."""
    groups = {}
    for doc_id, source, leaf in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id, leaf))
    named = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for *_, leaf in sorted(groups[s])], fanout) for s in named}
    root, tops = plain_tree([trees[s][0] for s in named], fanout)
    out = []
    for s, top in zip(named, tops):
        for (_, doc_id, leaf), path in zip(sorted(groups[s]), trees[s][1]):
            whole = [*path, *top]
            out.append((doc_id, s, leaf, trees[s][0], root, H("".join(a + b for a, b in whole)), whole))
    return out


def made(spark, rows, tmp, **options):
    spark.createDataFrame(rows, "doc_id long, source string, leaf string").write.parquet(tmp)
    df = spark.read.parquet(tmp)
    return merkle.manifest(df, "source", "doc_id", F.col("leaf"), **options)


@pytest.mark.parametrize("fanout, depth, size", [(2, 1, 37), (2, 2, 90), (3, 1, 163), (16, 1, 300), (16, 3, 50)])
def test_butterfly_against_a_plain_tree(spark, tmp_path, fanout, depth, size):
    rng = random.Random(size)
    names = [None, "", "a", "é", "z", "\U0001f600", *[f"s{i}" for i in range(fanout + 3)]]
    # one source has a third of all rows
    rows = [(i, "a" if i % 3 == 0 else rng.choice(names), H(f"leaf{i}")) for i in range(size)]
    got = made(spark, rows, f"{tmp_path}/t", fanout=fanout, depth=depth).collect()
    want = plain(rows, fanout)
    read = [(r.doc_id, r.source, r.leaf, r.subroot, r.root, r.proof_sha256, [tuple(p) for p in r.siblings]) for r in got]
    assert sorted(read, key=repr) == sorted(want, key=repr)
    assert all(r.folded_root == r.root for r in got)


@pytest.mark.parametrize("size", [1, 15, 16, 17, 256, 257])
def test_sizes_at_the_borders(spark, tmp_path, size):
    rows = [(i, "s", H(str(i))) for i in range(size)]
    got = made(spark, rows, f"{tmp_path}/t", depth=1).select("doc_id", "root", "proof_sha256").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], r[4], r[5]) for r in plain(rows))


def test_ids_beside_nulls_and_equal_rows(spark, tmp_path):
    rows = [(2**53 + 1, "a", H("x")), (None, "a", H("y")), (2**53, "a", H("z")), *[(5, None, H("same"))] * 40, (5, None, H("other"))]
    got = made(spark, rows, f"{tmp_path}/t", fanout=4, depth=1).collect()
    want = plain(rows, 4)
    assert sorted((repr(r.doc_id), r.leaf, r.proof_sha256) for r in got) == sorted((repr(w[0]), w[2], w[5]) for w in want)


def test_no_rows(spark, tmp_path):
    assert made(spark, [], f"{tmp_path}/t").collect() == []


def test_a_changed_leaf_does_not_fold_to_the_root(spark, tmp_path):
    rows = [(i, f"s{i % 3}", H(str(i))) for i in range(60)]
    claimed = F.when(F.col("doc_id") % 4 == 0, F.sha2(F.lit("forged"), 256))
    got = made(spark, rows, f"{tmp_path}/t", claimed=claimed, depth=1).collect()
    assert {r.doc_id for r in got if r.folded_root != r.root} == set(range(0, 60, 4))
    assert all(r.folded_root == merkle.fold(H("forged"), [tuple(p) for p in r.siblings]) for r in got if r.doc_id % 4 == 0)


def test_leaf(spark):
    df = spark.createDataFrame([(1, None, "é:"), (None, "", "")], "a int, b string, c string")
    got = [r[0] for r in df.select(merkle.leaf(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [H("1:1-3:é:"), H("-0:0:")]


def test_query_against_a_plain_version(spark, tmp_path):
    rows = [(i, f"Text {i}" if i % 2 else f"text {i}", f"s{i % 7}" if i % 11 else None) for i in range(300)] + [(None, None, None), (7, "Again", "s1")]
    docs(spark, rows, extra=("group", "pos", "digest", "block")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_merkle(spark, str(tmp_path)).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, s: H("".join(map(field, (i, s, "en", None if t is None else len(t), t))))
    want = {(w[0], w[2]): w for w in plain([(i, s, leaf(i, t, s)) for i, t, s in rows])}
    given = {(i, leaf(i, t, s)): (i, t, s) for i, t, s in rows}
    assert len(got) == len(rows)
    for r in got:
        w = want[(r.doc_id, r.leaf)]
        i, t, s = given[(r.doc_id, r.leaf)]
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        folded = merkle.fold(H("".join(map(field, (i, s, "en", len(t), t.lower())))) if tampered else r.leaf, w[6])
        assert (r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (w[3], w[4], w[5], folded, folded == w[4])
    assert {r.verified for r in got} == {True, False}
