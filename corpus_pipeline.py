"""The corpus pipeline: documents to packed training sequences in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardgate.llm import stages
from wardgate.llm.common import landed, table

STAGES = [
    ("language", stages.language),
    ("toxicity", stages.toxic),
    ("simhash", stages.near_duplicates),
    ("substrings", stages.repeated_substrings),
    ("packing", stages.packed),
]

#: No SQL twin: classifiers, near-duplicate components and packing have none; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each is written to the shared folder and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
