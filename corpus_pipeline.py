"""Cleaning pipeline: from the documents table to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written and read again as the next
one's docs. All but the last return the columns of documents.

Defined cases, for every stage: a null or empty text is a document like any other (no words, so no near duplicate, no
leak and no personal data; its only token is the end id) and a very long one is read whole; a row without an id is
kept and judged by its text; of repeated rows one stays where they have words, and all where they have none; an empty
table of documents gives an empty result, an empty one of labels or of the benchmark rejects nothing; extra columns,
whatever their names, pass through all stages but the last. A column score, or _pii, raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import decontamination, jaccard_join, packing, pii, quality_classifier
from strataline.llm.common import staged, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of docs."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.without_near_duplicates(docs, words=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark is found."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else redacted


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placed pieces of every document's tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_distinct),
    ("benchmark_decontamination", keep_uncontaminated),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]
#: The stages learn, link and pack; SQL expresses none of that, so tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
