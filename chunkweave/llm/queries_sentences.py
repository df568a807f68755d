"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm.sentences import split_sentences
from chunkweave.runtime import once_per_key, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, a repeated ``doc_id`` once; only repeated ones are shuffled."""
    return once_per_key(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "created_at"), "doc_id", "created_at")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = split_sentences(_documents(spark, sf_dir), "doc_id", "text", with_text=False, lang="lang")
    return units.select(F.col("item_id").alias("doc_id"), "end_pos")


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence texts in order, once per document."""
    units = split_sentences(_documents(spark, sf_dir), "doc_id", "text", lang="lang")
    return units.select(F.col("item_id").alias("doc_id"), "sentence_no", "end_pos", "sentence")


QUERIES = {"p8_found": p8_found, "p8_sentences": p8_sentences}
SQL: dict[str, str] = {}
