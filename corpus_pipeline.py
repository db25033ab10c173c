"""Corpus pipeline: documents to packed training sequences, in five stages of the training-data operators.

A stage takes the session, the rows that the one before kept, and the folder of
the input tables. All but the last return the columns of ``documents``, and all
give an empty table for an empty one. A null text counts as an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm._shared import scratch
from tidewake.llm.exact_dedup import drop_exact_duplicates
from tidewake.llm.mixing import mix
from tidewake.llm.packing import pack
from tidewake.llm.quality import fit_quality, quality_score
from tidewake.llm.queries import KEEP_QUALITY, tokenizer_path
from tidewake.llm.sampling import held_out
from tidewake.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of label 1 is at least KEEP_QUALITY. Equal texts, whatever their ids, stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id", 5, 0))
    model = fit_quality(
        labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("label")),
        docs.select(F.col("doc_id").alias("id"), "text"),
    )
    return docs.where(quality_score(F.col("text"), model, spark) >= KEEP_QUALITY)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id; one with a null id only if all have, and any one of repeated rows."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; rows with a null id stay."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document as often as it is taken, in the shuffled order of its shard. Documents without a word aren't taken."""
    mixed = mix(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids. Every row is packed, repeated ones and null ids too."""
    return pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained model, fingerprints and a tokenizer are beyond SQL; tests/llm compares stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch(spark, 'pipeline')}/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
