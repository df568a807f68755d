"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm.near_duplicates import near_duplicate_groups
from chunkweave.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "tmp_chunks_upload"), "id", "content")
    return groups.filter(F.col("id") != F.col("first_id")).select("first_id", "id")


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
