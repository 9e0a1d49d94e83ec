"""The documents' way to a training mix: five stages, each written as Parquet and read again by the next.

Every stage takes all that the one before kept. All but the last return the columns of ``documents``; the
last returns them once for each copy that the mix takes, numbered in ``copy`` from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import decontaminate, mixing, private, quality, simhash
from tarnlake.llm.common import stored, table


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it give way to their kind in brackets."""
    return private.sanitised(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for."""
    return mixing.emitted(mixing.mix(docs, carry=True))


STAGES = [
    ("quality classifier", classified),
    ("near duplicates", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("personal data", sanitised),
    ("source mix", mixed),
]

#: No SQL has the classifier's fit or XXH64; tests hold each stage, and run() by them, against plain Python and SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
