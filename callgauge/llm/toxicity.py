"""Toxicity of documents, learned from document labels by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic score over its words and word beginnings; the
document's is the noisy-or of its sentences, ``1 - prod(1 - p)``. Only documents carry labels, so the gradient of the
document's likelihood is passed down to the sentences: one sure sentence explains a toxic document, while every sentence
of a clean one is pushed down. After training the same sentence scores point at the offending sentences.

Training rows lie in Spark; every step sums one gradient vector per partition on the driver (``max_features`` numbers
each). Scoring is one pass over whole texts without a shuffle.

Null and empty texts have no sentences and score 0. Rows without a known label (null, or an id without a row in the
labels) are not learned from; an id labelled more than once counts as toxic if any label says so. Equal rows get equal
scores. Without any labelled row every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from callgauge.llm.shared import forget, keep

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that count as features besides the word itself.
BEGINNINGS = (4, 5)
#: A document is called toxic from this probability on, a sentence offending from half.
TOXIC, OFFENDING = 0.7, 0.5
SCORED = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "offending",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.IntegerType()),
                        T.StructField("end", T.IntegerType()),
                        T.StructField("score", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


def features(word: str) -> list[str]:
    return [word, *["^" + word[:n] for n in BEGINNINGS if len(word) > n]]


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """Start, end and lower-cased words of each sentence that has words."""
    found = ((m.start(), m.end(), WORD.findall(m[0].lower())) for m in SENTENCE.finditer(text or ""))
    return [x for x in found if x[2]]


@dataclass(frozen=True)
class Model:
    """Weights by feature and the bias of a sentence's logistic score."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = float("-inf")

    def scorer(self):
        """text -> (probability, [(start, end, probability) of offending sentences])."""
        known: dict[str, float] = {}

        def of(word: str) -> float:
            if (w := known.get(word)) is None:
                if len(known) >= 500_000:
                    known.clear()
                w = known[word] = sum(map(self.weights.get, features(word), repeat(0.0)))
            return w

        def score(text: str | None):
            parts = sentences(text)
            if not parts:
                return 0.0, []
            z = np.array([sum(map(of, set(words))) for _, _, words in parts]) + self.bias
            with np.errstate(over="ignore"):
                p = 1.0 / (1.0 + np.exp(-np.minimum(z, 40)))
            over = np.nonzero(p >= OFFENDING)[0]
            return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), [
                (parts[i][0], parts[i][1], float(p[i])) for i in over
            ]

        return score


def labelled(documents: DataFrame, labels: DataFrame, sample_rows: int, seed: int = 11) -> DataFrame:
    """(text, toxic) of about ``sample_rows`` labelled documents, picked by a hash of the id; all if there are fewer."""
    truth = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    share = min(1.0, sample_rows / max(1, truth.count()))
    picked = truth.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return documents.select("doc_id", "text").join(picked, "doc_id").where("text is not null").select("text", "toxic")


def train(
    documents: DataFrame,
    labels: DataFrame,
    sample_rows: int = 12_000,
    parts: int = 16,
    max_features: int = 4_000,
    min_documents: int = 3,
    min_chi2: float = 10.0,
    steps: int = 30,
    rate: float = 0.5,
    penalty: float = 1e-6,
    prior: float = -10.0,
    prior_weight: float = 0.05,
) -> Model:
    """Fits the model on a bounded sample of labelled documents (``sample_rows``), in ``parts`` partitions.

    Features are the words and word beginnings whose presence depends most on the label (chi-square, at least
    ``min_chi2``), ``max_features`` at most, each in ``min_documents`` sampled documents or more. The bias is held near
    ``prior`` (a sentence without evidence is hardly ever toxic), or a few toxic documents without known features would
    make long clean ones suspect. Full-gradient Adam, so the result does not depend on how rows are partitioned beyond
    the order of additions.
    """
    rows = keep(labelled(documents, labels, sample_rows).repartition(parts), "toxicity-sample")
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        return Model()
    a, n = F.col("toxic"), F.col("n")  # documents that have the feature: toxic ones, all
    counted = (
        rows.mapInPandas(_features_of, "feature string, n long, toxic long")
        .groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .where((n >= min_documents) & (n < total))
        .withColumn("chi2", total * F.pow(a * total - n * toxic, 2) / (n * (total - n) * float(toxic * (total - toxic))))
        .where(F.col("chi2") >= min_chi2)
    )
    names = [r[0] for r in counted.orderBy(F.desc("chi2"), "feature").limit(max_features).collect()]
    ids = {name: i for i, name in enumerate(names)}
    bags = keep(rows.mapInPandas(_encoder(ids), "toxic int, lengths binary, ids binary"), "toxicity-bags")
    width = len(names)
    x = np.zeros(width + 1)
    x[width] = prior
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        parts = bags.mapInPandas(_gradient(x), "part int, grad binary").collect()
        g = sum((np.frombuffer(r.grad) for r in sorted(parts, key=lambda r: r.part)), np.zeros(width + 1)) / total
        g[:width] += penalty * x[:width]
        g[width] += prior_weight * (x[width] - prior)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    forget(rows)
    forget(bags)
    return Model({name: float(w) for name, w in zip(names, x[:width])}, float(x[width]))


def scored(text: Column, model: Model) -> Column:
    """struct(score, offending) of a text: its probability, and span and probability of each offending sentence."""

    @F.pandas_udf(SCORED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for texts in batches:
            out = [score(t) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in out], "offending": [spans for _, spans in out]})

    return run(text)


def _features_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents and toxic documents that have each feature, summed over a batch."""
    for rows in batches:
        n, bad = Counter(), Counter()
        for text, toxic in zip(rows["text"], rows["toxic"]):
            found = {f for w in {w for _, _, ws in sentences(text) for w in ws} for f in features(w)}
            n.update(found)
            if toxic:
                bad.update(found)
        yield pd.DataFrame({"feature": list(n), "n": list(n.values()), "toxic": [bad[f] for f in n]})


def _encoder(ids: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text, toxic in zip(rows["text"], rows["toxic"]):
                bags = [
                    [i for w in set(ws) for f in features(w) if (i := ids.get(f)) is not None]
                    for _, _, ws in sentences(text)
                ]
                bags = [b for b in bags if b] or [[]]
                out.append(
                    (
                        int(toxic),
                        np.array([len(b) for b in bags], np.int32).tobytes(),
                        np.array([i for b in bags for i in b], np.int32).tobytes(),
                    )
                )
            yield pd.DataFrame(out, columns=["toxic", "lengths", "ids"])

    return run


def _gradient(x: np.ndarray):
    """Sum of the documents' gradients (weights, then bias) in a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total, seen = np.zeros(len(x)), False
        for rows in batches:
            for at in range(0, len(rows), 500):
                some = rows.iloc[at : at + 500]
                per_sentence = [np.frombuffer(b, np.int32) for b in some["lengths"]]
                lengths = np.concatenate(per_sentence)
                ids = np.concatenate([np.frombuffer(b, np.int32) for b in some["ids"]])
                sentence = np.repeat(np.arange(len(lengths)), lengths)
                doc = np.repeat(np.arange(len(some)), [len(s) for s in per_sentence])
                z = np.bincount(sentence, x[ids], len(lengths)) + x[-1]
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
                clean = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(some)))
                dz = p * np.where(some["toxic"].to_numpy() > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)[doc]
                total[:-1] += np.bincount(ids, dz[sentence], len(x) - 1)
                total[-1] += dz.sum()
                seen = True
        if seen:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "grad": [total.tobytes()]})

    return run
