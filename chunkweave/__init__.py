"""Spark-first engine for document corpora and knowledge bases.

Sub-packages: ``sources`` (readers, writers), ``functions`` (column helpers), ``operators``
(DataFrame -> DataFrame transformations), ``plans`` (queries registered for the driver, with their
SQL), ``streaming`` (Structured Streaming jobs) and the optional ``llm`` (training-data operators,
imported by nothing else here).
"""

__version__ = "0.1.0"
