import pytest
from helpers import docs
from pyspark.sql import functions as F

from callgauge.llm import toxicity
from callgauge.llm.queries import held_out, op1_toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = op1_toxicity(spark, folder)
    assert found.count() == 1000
    rows = found.where("held_out").join(truth, "doc_id").select("toxic", "predicted", "score").collect()
    right = sum(r.toxic == r.predicted for r in rows)
    clean = [r for r in rows if not r.toxic]
    assert right / len(rows) > 0.93
    assert sum(r.predicted for r in clean) / len(clean) < 0.03
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def small(spark):
    said = ["so it is said", "more of them here", "You and one thing", "a quite plain word", "number one of them"]
    rows = []
    for i in range(120):
        words = said[i % 5].split()
        rows.append((i, f"{said[i % 4]}. {' '.join(words[:2] + ['vile'] * (i % 3 == 0) + words[2:])}! {said[i % 3]}"))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)] + [(1, 1, None), (999, 1, 1), (None, 0, 1)], LABELS)
    return docs(spark, rows, ["score", "toxic", "label"]), labels


def test_finds_the_sentence(spark, small):
    model = toxicity.train(*small, min_chi2=5, steps=80, prior=-6.0)
    text = "Nothing here. A vile one. more of them here"
    df = docs(spark, [(1, text), (2, ""), (3, None), (4, "plain words " * 3000), (5, "?!.")])
    got = {r.doc_id: r.x for r in df.select("doc_id", toxicity.scored(F.col("text"), model).alias("x")).collect()}
    assert got[1].score >= toxicity.TOXIC
    assert [text[s.start : s.end].strip() for s in got[1].offending] == ["A vile one"]
    assert all(got[i].score < toxicity.TOXIC and got[i].offending == [] for i in (2, 3, 4, 5))
    assert got[2].score == got[3].score == 0.0


def test_noisy_or():
    score = toxicity.Model({"bad": 2.0}, -1.0).scorer()
    one = 1 / (1 + 2.718281828459045**-1)
    assert score("bad. bad.")[0] == pytest.approx(1 - (1 - one) ** 2)
    assert score("bad")[1] == [(0, 3, pytest.approx(one))]


def test_without_labels(spark, small):
    model = toxicity.train(small[0], spark.createDataFrame([], LABELS))
    assert model.scorer()("You vile thing")[0] == 0.0
    assert toxicity.train(small[0].limit(0), small[1]) == model


def test_held_out_rows_are_not_learned_from(spark, small):
    marked = small[1].withColumn("toxic", F.when(held_out(), 1).otherwise(F.lit(0)))
    assert toxicity.train(small[0], marked.where(~held_out())).weights == {}
