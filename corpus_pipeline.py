"""A training corpus from raw documents, in stages.

1. toxicity: documents scored 0.7 or more go.
2. simhash: of each group of near-duplicates the document with the smallest id stays.
3. decontamination: documents with a passage of a benchmark item go.
4. secrets: secrets are replaced in the text by their kind in brackets; every document stays.
5. mixing: documents get the number of repetitions that brings their source to its target; those with none go.

Every stage gets the documents its predecessor kept, all of them, with all their columns. Rows that agree in id and text
are copies of one document: the second stage keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from callgauge.llm import decontaminate, mixing, secret_spans, simhash, toxicity
from callgauge.llm.queries import held_out
from callgauge.llm.shared import fresh, keep, matching
from callgauge.session import prepare
from callgauge.sources.tables import table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents that came in, held-out ones aside."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    score = toxicity.scored(F.col("text"), model)["score"]
    return docs.where(score < toxicity.TOXIC)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, and one row of a document that is repeated as it is."""
    grouped = keep(simhash.groups(docs).select("id", "text_hash", "label"), "groups")
    stay = keep(simhash.survivors(grouped), "survivors")
    repeated = grouped.groupBy("id", "text_hash").count().where("count > 1").select("id", "text_hash")
    repeated = keep(stay.intersect(repeated), "repeated")
    kept = matching(docs, stay, "doc_id", "text", "left_semi")
    if repeated.isEmpty():
        return kept
    once = matching(kept, repeated, "doc_id", "text", "left_anti")
    return once.unionByName(matching(kept, repeated, "doc_id", "text", "left_semi").dropDuplicates(["doc_id", "text"]))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, hits = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    found = keep(hits.where(F.size("items") > 0).select("id", "text_hash").distinct(), "contaminated")
    return matching(docs, found, "doc_id", "text", "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the text changes, ``n_chars`` follows it."""
    new = fresh(docs, "masked")
    out = docs.withColumn(new, secret_spans.masked(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = ~F.col(new).eqNullSafe(F.col("text"))
        out = out.withColumn("n_chars", F.when(changed, F.length(new).cast(kind)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(new)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are taken at all, with ``repeats`` and ``taken`` (words, repetitions counted) besides."""
    planned = mixing.plan(keep(mixing.placed(docs), "mix"))
    size = fresh(docs, "size_in_words")
    tagged = docs.withColumn(size, mixing.words(F.col("text")))
    names = [fresh(docs, c) for c in ("source_size", "target", "repeats", "taken")]
    mixed = mixing.repeated(tagged, planned, F.col(size), mixing.order_of(), names)
    return mixed.where(F.col(names[2]) > 0).select(*docs.columns, *names[2:])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("simhash", remove_near_copies),
    ("decontamination", remove_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]
#: SQL has neither the classifier nor the fingerprints; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage's result is written as Parquet and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
