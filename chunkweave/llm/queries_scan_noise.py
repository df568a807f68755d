"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkweave.llm.scan_noise import repair_scans, scan_noise
from chunkweave.runtime import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise(table(spark, sf_dir, "tmp_chunks_upload"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's text as continuous paragraphs."""
    return repair_scans(table(spark, sf_dir, "tmp_chunks_upload"))


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
SQL: dict[str, str] = {}
