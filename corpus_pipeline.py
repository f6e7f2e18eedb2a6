"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes what the one before kept.  All but the last return the
columns of documents; the last returns every piece with its sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakefind.llm.common import table
from lakefind.llm.decontaminate import clean_documents
from lakefind.llm.jaccard_join import one_of_each
from lakefind.llm.line_dedup import drop_repeated_lines
from lakefind.llm.packing import pack_documents
from lakefind.llm.quality import fit_sample, quality_scores
from lakefind.plans.registry import query
from lakefind.session import materialize

#: The quality network, the similarity join and the packing have no SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts; it learns from the labels of the given rows."""
    net = fit_sample(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, net).where("predicted = 1").select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that five or more of them share."""
    return drop_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("document_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
