"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows the one before it kept, and its result is
written as Parquet and read again as the next one's ``docs``.  A stage begins by removing the tables that earlier
ones stored for themselves and its ``docs`` no longer read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsflow.llm import op2_substring, op3_decontamination, op6_neardup, op7_quality, op9_packing
from newsflow.llm.tables import discard, read, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    discard(spark, docs)
    return op7_quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    discard(spark, docs)
    return op6_neardup.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated passages go from all but their first document; documents stay."""
    discard(spark, docs)
    return op2_substring.remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a test item go."""
    discard(spark, docs)
    return op3_decontamination.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    discard(spark, docs)
    return op9_packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: SQL has no n-gram model, sketches or tokenizer: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
