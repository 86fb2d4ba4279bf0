"""A corpus pipeline of five stages; each takes the documents that its predecessor kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

Defined cases, in all stages.  Null text counts as empty, and whole texts are read
however long.  An empty table gives an empty one.  Extra columns pass through,
whatever their names, up to the last stage, which returns its own columns.  Each
stage says what it does with null ids, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, exact_dedup, jaccard_join, mixing, quality_fm, shared


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Each row is judged by its text alone: repeated rows stay or go together, rows
    without an id are judged like others, and an empty text has a score too.
    """
    return quality_fm.accepted(docs, shared.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, against an index of this run.

    Of equal texts the row with the largest id stays, of repeated rows one; a row
    without an id stays only where no row of its text has one.
    """
    return exact_dedup.keep_new(docs, exact_dedup.DigestIndex(spark, shared.scratch(spark, "digest-index")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near duplicates.

    Empty texts are nobody's duplicates, and rows without an id stay.
    """
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their targets.

    The draw follows from the id (without one, from the text), so repeated rows
    stay or go together; null sources and languages are values of their own.
    """
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: token ids of each row; an empty text has none, and repeated rows repeat theirs."""
    path, pattern = bpe.public_files()
    found = bpe.encode(docs, path, pattern)
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: The first stage, a trained model, can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
