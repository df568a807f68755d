"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm.segment import split_oversized
from chunkweave.runtime import once_per_key, table


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized rows: null contents never pass the filter."""
    return table(spark, sf_dir, "tmp_chunks_upload").select("id", "content", "created_at").filter(F.length("content") > 1000)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids the splitter had to cut into more than one piece."""
    cut = split_oversized(table(spark, sf_dir, "tmp_chunks_upload"), "id", "content")
    return cut.filter((F.col("piece_no") == 0) & (F.col("n_pieces") > 1)).select(F.col("item_id").alias("id")).distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the oversized contents, once per id."""
    rows = once_per_key(_oversized(spark, sf_dir).filter("id IS NOT NULL"), "id", "created_at")
    return split_oversized(rows, "id", "content").select(
        F.col("item_id").alias("id"), "piece_no", "start_pos", "end_pos", "cut", "piece"
    )


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}

SQL = {
    "p1_found": "SELECT DISTINCT id FROM tmp_chunks_upload WHERE length(content) > 1000",
}
