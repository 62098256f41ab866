"""A training-data pipeline over `documents`, stage by stage; each stage works on all that its predecessor kept.

Quality rules drop rejected documents, exact deduplication keeps one of equal texts (the largest id), the n-gram Jaccard
join keeps one of each class of near copies (the smallest id), personal data is masked in the texts, and packing places the
remaining documents in length buckets and token-budget batches.

Defined cases: a document whose text is null or empty has too few words, so quality rules drop it; texts of any length go through whole;
documents with a null id are rows like others, and of equal texts one with an id is kept before one without; rows repeated in id and text
are one document after exact deduplication; an empty table gives an empty result; columns beyond those of documents are carried to the
last stage, whatever their names, and are left out by packing, whose columns are its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, ngram_join, packing, pii, quality_rules
from tarn.llm.common import stored
from tarn.llm.queries import BUCKETS, TOKEN_BUDGET


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_rows(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.lengths_of(docs), TOKEN_BUDGET, BUCKETS).withColumnRenamed("key", "doc_id")


STAGES = [("quality rules", quality), ("exact dedup", dedup), ("n-gram Jaccard join", near_dedup), ("PII", mask_pii), ("packing", pack)]

#: The join, the model and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
