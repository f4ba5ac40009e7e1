"""Corpus pipeline: toxic documents go, repeated lines go, one document of each near copies stays, documents with
benchmark passages go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and its result is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm import decontamination, line_dedup, near_dedup, pieces
from proselens.llm import toxicity as toxic
from proselens.llm.common import bounded, cut, drop, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored under 0.5; the model learns from the labelled ones among those not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxic.held_out())
    model = toxic.train(docs.where(~toxic.held_out()), labels)
    return toxic.clean(docs, model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood earlier; those of which every line stood earlier go, all others stay."""
    bounded(spark)
    left = line_dedup.clean(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (the one of smallest doc_id); rows without doc_id stay, all of them."""
    bounded(spark)
    return near_dedup.representatives(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, the number of these, and the hashes of ids and of the decoded text."""
    bounded(spark)
    return pieces.tokens(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontaminated),
    ("pieces", encoded),
]

#: SQL can neither train the toxicity model nor encode pieces; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        drop(before)
    return docs
