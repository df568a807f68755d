"""Registered queries: each module here has ``QUERIES`` (name -> callable) and ``SQL`` (name -> text)."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession


def _modules() -> list:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if not m.name.startswith("_")]


def queries() -> dict:
    return {name: run for m in _modules() for name, run in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in _modules() for name, text in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chunkweave.plans import retrieval

    return retrieval.QUERIES["bm25_topk"](spark, sf_dir)
