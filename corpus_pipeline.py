"""A training-data pipeline over ``documents``: quality classifier, near-duplicate removal by
n-gram Jaccard join (words in fives, 0.8), substring deduplication, benchmark
decontamination, and the mix of the sources to their target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet to the shared work folder and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retentia.llm.common import stored, table
from retentia.llm.decontaminate import drop_leaks
from retentia.llm.jaccard import keep_one
from retentia.llm.mixing import mix_sources
from retentia.llm.quality import keep_good
from retentia.llm.substring import remove_spans


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (operator 2)."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the smallest id (operator 6)."""
    return keep_one(docs, n=5, num=80, den=100)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller id has go (operator 10)."""
    return remove_spans(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go (operator 9)."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document for the sources' target weights (operator 5)."""
    return mix_sources(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: The stages train models and connect components; SQL cannot express them.  Tests hold them
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
