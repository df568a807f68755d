"""Writers: exports and backups of chunks, and appends that ignore rows already there."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.text import joined_text
from chunkweave.operators.merge import first_of


def search_text(title: str = "title", content: str = "content", source: str = "source") -> Column:
    """What the text index sees of a chunk."""
    return joined_text(title, content, source)


def normal_related(column: str) -> Column:
    """Related ids as JSON text: null and blank become an empty list, a bare id a list of one."""
    parsed = F.from_json(column, "array<string>")
    bare = F.trim(F.coalesce(F.col(column), F.lit("")))
    ids = F.when(parsed.isNotNull(), F.filter(parsed, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")).when(bare.isin("", "null"), F.array().cast("array<string>")).otherwise(F.array(bare))
    return F.to_json(ids)


def document_export(documents: DataFrame, chunks: DataFrame, relations: DataFrame, triples: DataFrame) -> DataFrame:
    """One row per chunk of a document with counts of its relations and triples; pages are 1-based.

    ``documents``: ``id, kb_id, filename``; ``chunks``: the chunk table; ``relations``: ``src_id``; ``triples``:
    ``source_chunk``. Both are counted before they are joined.
    """
    linked = relations.groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("relations"))
    known = triples.groupBy(F.col("source_chunk").alias("id")).agg(F.count("*").alias("triples"))
    owner = documents.select(F.col("id").alias("document_id"), "filename")
    joined = chunks.join(owner, "document_id").join(linked, "id", "left").join(known, "id", "left")
    return joined.select(
        "document_id", "filename", "id", "chunk_index", (F.coalesce("page", F.lit(0)) + 1).alias("page"), "layer", F.coalesce("title", F.lit("")).alias("title"), "content",
        normal_related("related_ids").alias("related_ids"), F.coalesce("relations", F.lit(0)).alias("relations"), F.coalesce("triples", F.lit(0)).alias("triples"),
    )


def backup_rows(chunks: DataFrame, vectors: DataFrame, size: int, version: str = "1") -> DataFrame:
    """Chunks with their vectors as JSON, ready for a CSV that :func:`readers.read_backup` reads; ones without a vector fail."""
    joined = chunks.join(vectors.select("id", "embedding"), "id", "left")
    checked = joined.withColumn("__ok", F.assert_true(F.coalesce(F.size("embedding") == size, F.lit(False)), F.lit("a chunk has no vector of the right size"))).filter("__ok IS NULL")
    return checked.select(F.lit(version).alias("schemaVersion"), "id", "content", (F.coalesce("page", F.lit(0)) + 1).alias("page"), normal_related("related_ids").alias("related_ids"), F.to_json("embedding").alias("embedding"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and doubled quotes; one file per partition, so nothing is gathered."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    """Append the rows whose key the table does not hold; of repeated keys the first by ``order`` wins."""
    spark = df.sparkSession
    rows = first_of(df, keys, order)
    try:
        rows = rows.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").parquet(path)


def file_hash(content: Column | str) -> Column:
    """SHA-256 of a file's bytes."""
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def write_in_steps(spark: SparkSession, steps: Sequence[tuple[str, Callable[[], int | None], bool]]) -> DataFrame:
    """``step_no, step, rows, seconds, failure``: the steps ``(name, run, required)`` in order, with their times.

    ``run`` writes and gives its number of rows. A required step that fails ends the write with its error; of others the
    failure is noted and the rest goes on.
    """
    out = []
    for number, (name, run, required) in enumerate(steps):
        began, rows, failure = time.monotonic(), None, None
        try:
            rows = run()
        except Exception as e:
            if required:
                raise
            failure = f"{type(e).__name__}: {e}".split("\n")[0]
        out.append((number, name, rows, time.monotonic() - began, failure))
    return spark.createDataFrame(out, "step_no int, step string, rows bigint, seconds double, failure string")
