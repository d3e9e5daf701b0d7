"""The corpus pipeline: grades, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All stages but the last return the columns of `documents`.
Null texts stay null unless a stage drops the row; empty tables give empty results; columns besides
those of `documents` pass through; rows without an id are documents too: they lose to a near copy with an
id, and neither lose words to others nor take any; rows that share an id but not the text are documents of
their own, but for the repeated passages, where they are one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontamination, ordinal, packing, similar, substrings
from foliant.llm.common import read_table, stage_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal grades keep."""
    return ordinal.good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group with five-word shingle similarity of 0.8 or more."""
    return similar.one_of_each(docs, size=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words and more that a smaller id has; unchanged where there are none."""
    cleaned = substrings.remove_repeats(docs, window=13, keep_unchanged=True, flush_words=200_000).select(F.col("doc_id").alias("__doc"), F.col("n_removed").alias("__removed"), F.col("kept").alias("__kept"))
    joined = docs.join(cleaned.dropDuplicates(["__doc"]), docs["doc_id"] == F.col("__doc"), "left")
    text = F.when(F.col("__removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    return joined.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontamination.without_benchmark(docs, read_table(spark, sf_dir, "benchmark"), window=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_passages", benchmark_passages), ("packing", packed)]

#: SQL can express neither the fitted grades nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = stage_folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
