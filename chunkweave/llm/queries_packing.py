"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm.packing import fill_report, packed
from chunkweave.runtime import table


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return placed.select("container", "start", F.col("item_id").alias("doc_id"), "piece_no", "token_start", "n_tokens")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of used space."""
    return fill_report(packed(table(spark, sf_dir, "documents"), "doc_id", "text"))


QUERIES = {"p6_packed": p6_packed, "p6_fill": p6_fill}
SQL: dict[str, str] = {}
