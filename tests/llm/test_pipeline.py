from collections import Counter

import pytest
from helpers import union_find
from pyspark.sql import functions as F
from test_decontaminate import plain as plain_hits
from test_simhash import plain as plain_fingerprint

import corpus_pipeline
from callgauge.llm import secret_spans, simhash, toxicity
from callgauge.llm.queries import held_out
from callgauge.llm.shared import keep

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into each stage and what comes out, on the documents and rows that ask for trouble."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    text = docs.orderBy("doc_id").first()["text"]
    odd = [
        (None, "some words of a text without an id"),
        (None, "some words of a text without an id"),
        (9001, None),
        (9002, ""),
        (9003, "x " * 40_000),
        (9004, text),
        (9004, text),
        (9005, f"before {item} after"),
        (9006, "my token = abcdefghijkl0123 and 0123456789abcdef01"),
        (9007, "repeated with one id"),
        (9007, "repeated with one id, but as another text altogether, of other words"),
    ]
    more = spark.createDataFrame([(i, t, "en", None, 0 if t is None else len(t)) for i, t in odd], docs.schema)
    more = more.unionByName(docs.limit(1))
    # columns named as stages name theirs
    now = docs.unionByName(more).selectExpr("*", "'a' as score", "1 as text_hash", "'b' as size", "2L as repeats", "'c' as id", "'d' as plan")
    seen = [keep(now, "in")]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(keep(stage(spark, seen[-1], FOLDER), name))
    return seen


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert steps[-1].columns[: len(steps[0].columns)] == steps[0].columns
    assert steps[-1].where("score <> 'a' or size <> 'b' or id <> 'c' or plan <> 'd' or repeats <> 2").count() == 0


def test_toxicity(spark, steps):
    model = toxicity.train(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet").where(~held_out()))
    score = model.scorer()
    assert Counter(rows(steps[1])) == Counter(r for r in rows(steps[0]) if score(r[1])[0] < toxicity.TOXIC)
    assert len(rows(steps[1])) < len(rows(steps[0]))


def test_near_copies(steps):
    given = rows(steps[1])
    fps = [plain_fingerprint(t) for _, t in given]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= simhash.RADIUS]
    root = union_find(len(given), near)
    kept = rows(steps[2])
    assert len(kept) == len(set(root))
    # one of each group, the one with the smallest id
    least = {}
    for (i, _), r in zip(given, root):
        least.setdefault(r, []).append((i is None, i))
    assert sorted((i for i, _ in kept), key=repr) == sorted((min(x)[1] if None not in min(x) else None for x in least.values()), key=repr)
    assert not Counter(kept) - Counter(given)


def test_decontamination(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    given = rows(steps[2])
    clean = Counter(r for r in given if not plain_hits([r], items)[0][2])
    assert Counter(rows(steps[3])) == clean
    assert 9005 not in {i for i, _ in clean}


def test_secrets(steps):
    given, got = rows(steps[3]), rows(steps[4])
    search = secret_spans.finder(secret_spans.RULES)
    assert Counter(got) == Counter((i, secret_spans._mask(t, s)) for (i, t), s in zip(given, search([t for _, t in given])))
    assert (9006, "my [ASSIGN] and [HEX]") in got
    assert steps[4].where("n_chars <> length(text)").join(steps[3].where("n_chars <> length(text)"), "doc_id", "left_anti").count() == 0


def test_mixing(steps):
    given = Counter(rows(steps[4]))
    kept = steps[5].select("doc_id", "text", "source", "_repeats", "taken").collect()
    assert not Counter((r.doc_id, r.text) for r in kept) - given
    assert all(1 <= r._repeats <= 2 for r in kept)
    words = steps[4].select("source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    total = words.agg(F.sum("n")).first()[0]
    longest = words.agg(F.max("n")).first()[0]
    assert abs(sum(r.taken for r in kept) - 1.5 * total) <= longest * len({r.source for r in kept})


def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "repeats", "taken"]
    assert 0 < got.count() <= 200


def test_empty(spark, steps):
    now = steps[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = keep(stage(spark, now, FOLDER), "empty")
    assert now.count() == 0
