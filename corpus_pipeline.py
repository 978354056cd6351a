"""A training-data pipeline over documents: quality, exact, near and substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but the last return the
columns of documents. No stage but the first drops a document that has no copy: exact dedup drops equal texts, near
dedup all but the smallest of each group, substring dedup cuts repeated passages out of the later documents (and drops
a document of which nothing is left).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import exact_dedup, minhash, packing, quality, substring
from tidewrack.llm.common import Scratch, documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_smallest(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.without_passages(docs, substring.repeated_passages(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier, the MinHash components, the alignments or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again, the last one lazily."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = scratch.table(docs)
    return docs
