"""The corpus pipeline: documents through five operators, each stage written and read again.

Each stage works on all rows that the one before kept.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicscope.llm.byte_bpe import round_trip_report
from topicscope.llm.decontamination import without_benchmark
from topicscope.llm.jaccard_forest import keyed_classes, with_row_keys
from topicscope.llm.quality_rules import quality_filter
from topicscope.llm.secret_scan import without_secrets
from topicscope.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_filter(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of copies and near copies: the one with the smallest id, rows without an id
    last, and one of several with that id.  Rows are told apart by a key of their own, so repeated rows, null ids
    and ids that different texts share cost no group its row and keep no copy."""
    keyed = with_row_keys(docs.select(*COLUMNS))
    others = keyed_classes(keyed).where("class_key <> row_key").select(F.col("row_key").alias("__key")).hint("shuffle_hash")
    return keyed.join(others, F.col("row_key") == F.col("__key"), "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return without_benchmark(docs.select(*COLUMNS), benchmark)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; n_chars follows."""
    return without_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the byte-level BPE ids of what is left, and of the decoded bytes."""
    return round_trip_report(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("byte_bpe", encoding),
]

#: The later stages are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each stage's rows written to the shared folder and read again."""
    folder = scratch_path(spark, f"pipeline-{uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
