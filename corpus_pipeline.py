"""Corpus pipeline: quality rules, near-duplicate removal, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared
folder and read again as the next stage's documents. All stages but the last return the columns
of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import shared_path, table
from gridloom.llm.jaccard import keep_one
from gridloom.llm.mixing import mix
from gridloom.llm.packing import pack_documents
from gridloom.llm.quality import keep_good
from gridloom.llm.substrings import remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line field reject go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at a similarity of 0.8: the smallest id of each component stays."""
    return keep_one(docs, k=5, threshold=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur again anywhere are cut out of the texts."""
    return remove(docs, window=50)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are flattened by temperature: each gives all its documents, small ones up to two
    epochs; every use of a document is a row."""
    return mix(docs).drop("mix_epoch")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Stages 1 to 3 and 5 (a trained field, transitive components, automata, a search) have no SQL form; tests
#: hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
