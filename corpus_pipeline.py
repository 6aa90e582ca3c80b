"""From raw documents to packed training sequences: five stages, each on all that the one before kept.

    quality      drops texts outside their compression band, too short or repetitive
    exact        keeps one of each group of equal texts
    near         keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more
    mix          repeats documents until every source has its share
    pack         cuts documents into token pieces and packs them into sequences

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltawarden.llm import compression, fingerprints, mixing, packing, resemblance
from deltawarden.session import cut_lineage, local_scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compression.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    local_scratch(spark)
    return fingerprints.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    local_scratch(spark)
    return resemblance.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    local_scratch(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    local_scratch(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

# Compression, components of near copies and token ids are beyond SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written before the next one reads it."""
    local_scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
