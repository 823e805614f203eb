"""A training corpus from documents: language ID, exact dedup, near dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; it is written as Parquet and read
again before the next. All but the last return the columns of documents; the last returns (doc_id, ids, offsets,
round_trip), a row a document that is left.

Defined cases: rows without a text or without letters are rejected by the first stage, so no later one sees a null text;
rows with a null id are judged on their own text, kept by near dedup and decontamination, and encoded; of repeated rows
one is left after exact dedup; rows that share an id stay or go together from near dedup on; ties go to the smallest id;
very long texts are worked on whole; an empty table gives no rows; other columns, whatever their names, pass through to
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomquery.llm import bpe, decontaminate, exact_dedup, langid, near_dedup
from loomquery.llm.common import read
from loomquery.sources.scratch import scratch

#: Rows of a batch that the session hands to Python while it runs the pipeline: executors then hold little text beside
#: their heap. The pipeline owns its session; ``run`` puts the setting back, stages called one by one leave it.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tuned(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return near_dedup.near_deduplicate(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return bpe.encode(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("byte_bpe", tokens)]

#: Neither language models nor near dedup nor BPE can be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs, before = read(spark, sf_dir, "documents"), spark.conf.get(_BATCH)
    try:
        for name, stage in STAGES:
            path = scratch(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return docs
