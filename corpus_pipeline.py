"""Corpus pipeline: language ID, near duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's result as Parquet in the cluster's shared checkpoint folder and reads it
back as the next one's input. All stages but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playstat.llm import decontamination, language_id, ngram_join, packing, pii
from playstat.llm.storage import materialise, small_batches, table, unused


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without any letter of the labelled rows' texts
    (none, where no row is labelled). The score depends on the size of the alphabet and the
    length of the text, so it rejects nothing."""
    small_batches(spark)
    profiles = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    if not profiles.names:
        return docs
    names = tuple(unused(name, docs.columns) for name in ("_language", "_language_score", "_language_letters"))
    told = language_id.predict(docs, profiles, names)
    return told.where((F.col(names[0]) != language_id.UNKNOWN) & F.col(names[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark windows out of the texts."""
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return packing.pack_documents(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("packing", pack),
]

ORACLE_SQL = None              # language profiles, bootstrap and packing are not SQL; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
