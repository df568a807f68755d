"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm.leakage import leaked_items, proximity_matches
from chunkweave.runtime import table

_TEXTS = ["query", "ground_truth_answer"]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_records"), "id", _TEXTS)
    return found.select(F.col("doc_key").alias("doc_id"), F.col("item_key").alias("item_id"))


def p7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with several terms of an item close together."""
    found = proximity_matches(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_records"), "id", _TEXTS)
    return found.select(F.col("doc_key").alias("doc_id"), F.col("item_key").alias("item_id"), "terms")


QUERIES = {"p7_found": p7_found, "p7_proximity": p7_proximity}
SQL: dict[str, str] = {}
