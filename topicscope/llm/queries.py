"""Registered queries of the subpackage (name -> function of (spark, sf_dir))."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicscope.llm import oracle
from topicscope.llm.byte_bpe import round_trip_report
from topicscope.llm.decontamination import benchmark_matches
from topicscope.llm.filter_audit import filter_audit
from topicscope.llm.jaccard_forest import jaccard_classes
from topicscope.llm.language_fusion import fused_languages
from topicscope.llm.preference import preference_format, reply_pairs
from topicscope.llm.quality_rules import quality_rules
from topicscope.llm.secret_scan import secret_report
from topicscope.llm.spelling_variants import spelling_variants
from topicscope.llm.token_files import token_file_report
from topicscope.llm.url_templates import judge_urls
from topicscope.llm.warc import archive_report
from topicscope.llm.word_transducer import token_counts

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_report(_table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_report(_table(spark, sf_dir, "documents"), BYTE_RANKS)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format(reply_pairs(_table(spark, sf_dir, "conversations")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op10_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_languages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without a rule take their label from ``labels`` by doc_id = page_id: bad if of low quality or toxic."""
    labels = _table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return judge_urls(_table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_forest, op2_token_counts, op3_token_files, op4_byte_bpe, op5_secret_scan, op6_preference_format,
        op7_decontamination, op8_warc, op9_quality_rules, op10_language_fusion,
        op11_filter_audit, op12_spelling_variants, op13_url_templates, pipeline,
    )
}
ORACLE = dict(oracle.ORACLE)
