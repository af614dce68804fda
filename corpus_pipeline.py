"""A corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, best-fit packing.

Every stage takes all documents that its predecessor kept. The first three return documents with all
their columns; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import exact_dedup, jaccard, packing, quality
from siftwork.session import Scratch, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(spark, docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by shingles of five words at 0.8 or more."""
    return jaccard.one_of_each(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.pack_documents(spark, docs)


STAGES = [("quality_classifier", keep_good), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("best_fit_packing", pack)]

#: A fitted model, tokenizer ids and packing are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    work = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
