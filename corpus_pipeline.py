"""From raw documents to token ids: quality rules, near-duplicates, source mix, encoding.

Each stage takes the stored rows that its predecessor kept.  All but the last return the
columns of ``documents``; a row that the mix takes several times is there several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import bpe, mixing, quality, simhash
from aerolith.llm.common import small_batches
from aerolith.sources.writers import settle
from aerolith.workload.registry import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, alone and as part of their source."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that of the least id: three-word shingles, three differing bits."""
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, as little-endian unsigned 32-bit integers, and whether they decode to its text."""
    found = small_batches(docs).select("doc_id", "source", bpe.encoded_checked(F.col("text")).alias("found"))
    return found.select(
        "doc_id", "source", (F.octet_length("found.ids") / 4).cast("long").alias("n_tokens"), "found.ids", "found.intact")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("byte-level BPE", encode),
]

#: No SQL: DuckDB has neither the fingerprints' hash nor the merges of the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
