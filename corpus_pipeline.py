"""Training-corpus pipeline over ``documents``.

Quality rules, exact dedup, SimHash near-dedup, mixing to target weights and packing run
one after the other.  Each stage reads all that the one before it kept, as Parquet, and
returns the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm.common import materialize, read_table, scratch
from tracewright.llm.exact_dedup import drop_duplicates
from tracewright.llm.mixing import take_mix
from tracewright.llm.packing import pack_documents
from tracewright.llm.quality_rules import keep_good
from tracewright.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_duplicates(docs, in_place=True)  # stages are handed Parquet


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, a repeated one once for each time."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of at most 2048 tokens."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL has neither the fingerprints nor the tokenizer; ``tests/llm/test_pipeline.py`` holds
#: ``run`` and each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table below ``sf_dir``.

    What a stage writes on its way goes when its rows are written, and what stages hand on
    when the last has written its own.
    """
    docs = read_table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            with scratch(spark):
                docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
        name, stage = STAGES[-1]
        return materialize(stage(spark, docs, sf_dir), name, keep=True)
