"""A training corpus from raw documents: five stages, each over all that the one before has kept.

The stages filter rows and keep the columns of documents; the last gives the number of words that the mix takes from
each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wakeline.llm._shared import keep, table
from wakeline.llm.decontamination import drop_contaminated
from wakeline.llm.exact_dedup import drop_exact_copies
from wakeline.llm.jaccard_join import keep_one_of_each
from wakeline.llm.language_id import drop_unidentified
from wakeline.llm.mixing import mix_sources


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document left."""
    return mix_sources(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("benchmark_decontamination", benchmark), ("mix_sources", mix)]

#: The near duplicates are found by MinHash, which SQL cannot express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
