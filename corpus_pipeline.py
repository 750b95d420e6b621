"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read back as the next stage's documents. All but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import decontamination, language_id, mixing, sharding, similarity_join
from lakeloom.plans.runtime import checkpoint_dir, remove, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like a language learned from the labelled ones; gibberish, other languages and text without letters go."""
    return language_id.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest doc_id; documents without words all stay."""
    return similarity_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.assign(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", clean_of_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: Rank-order profiles have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the folder's documents. A stage's folder goes when the next one's is complete."""
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before is not None:
            remove(spark, f"{at}/{before}")
        before = name
    return docs
