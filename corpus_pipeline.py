"""From documents to training sequences: each stage works on all that the one before it kept.

The first four stages return rows with the columns of ``documents``, the last the pieces of the packed sequences. Each stage is
written as Parquet and read again by the next, so that a lost executor costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm import exact, jaccard, mixing, packing, quality
from tableferry.llm.store import staged, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects: score below 0.3."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays."""
    return exact.drop_copies(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts, the document with the smallest doc_id stays."""
    return jaccard.keep_one(spark, docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; a last repetition may be cut at a word."""
    mixed = mixing.repeat_documents(spark, docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids and places in the sequences."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("packing", packed_sequences),
]

# A classifier and a tokenizer are not SQL; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = staged(spark, stage(spark, docs, sf_dir), f"stage-{at}")
    return docs
