"""Queries of problem 4: references to chunks that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.functions.ids import canonical_uuid
from chunkweave.operators.references import classify_orphans, orphan_references, orphan_report
from chunkweave.runtime import first_rows, table


def chunk_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kb_id, target_id, created_at, deleted`` of every delivered chunk."""
    chunks = (
        table(spark, sf_dir, "tmp_chunks_upload")
        .select(canonical_uuid("id").alias("target_id"), "kb_id", "created_at")
        .filter(F.col("target_id").isNotNull())
        .groupBy("target_id", "kb_id")
        .agg(F.min("created_at").alias("created_at"))
    )
    logs = (
        table(spark, sf_dir, "kb_audit_logs")
        .filter(F.col("action").isin("chunk.delete", "chunk.restore") & (F.col("resource_type") == "chunk") & (F.col("outcome") == "success"))
        .select("id", canonical_uuid("resource_id").alias("gone_id"), "action", "created_at")
    )
    # Repeated log rows: the earliest delivery of an id counts.
    logs = first_rows(logs, "id", "created_at").filter(F.col("gone_id").isNotNull())
    last = logs.groupBy("gone_id").agg(F.max_by("action", F.struct("created_at", "id")).alias("last"))
    gone = last.filter(F.col("last") == "chunk.delete").select("gone_id")
    joined = chunks.join(gone, chunks["target_id"] == gone["gone_id"], "left")
    return joined.select("kb_id", "target_id", "created_at", F.col("gone_id").isNotNull().alias("deleted"))


def chunk_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_table, ref_key, kb_id, target_id, created_at``: one row per referring row and target.

    References name a chunk in any base, so ``kb_id`` is null: the key is partly null.
    """
    chunks = first_rows(table(spark, sf_dir, "tmp_chunks_upload").select("id", "related_ids", "created_at"), "id", "created_at")
    listed = F.from_json("related_ids", "array<string>")
    related = chunks.select(
        F.lit("tmp_chunks_upload").alias("ref_table"),
        F.col("id").alias("ref_key"),
        F.explode(F.array_distinct(F.transform(listed, canonical_uuid))).alias("target_id"),
        "created_at",
    )
    parts = [related]
    for name, column in (("tmp_kg_triples_upload", "source_chunk"), ("tmp_chunk_relations_upload", "dst_id")):
        rows = first_rows(table(spark, sf_dir, name).select("id", column, "created_at"), "id", "created_at")
        parts.append(
            rows.select(F.lit(name).alias("ref_table"), F.col("id").cast("string").alias("ref_key"), canonical_uuid(column).alias("target_id"), "created_at")
        )
    refs = reduce(DataFrame.unionByName, parts)
    return refs.withColumn("kb_id", F.lit(None).cast("string"))


def _orphans(spark: SparkSession, sf_dir: str, targets: DataFrame) -> DataFrame:
    return orphan_references(
        chunk_references(spark, sf_dir),
        targets.filter(~F.col("deleted")),
        ["kb_id", "target_id"],
        match="partial",
        ref_at="created_at",
        target_at="created_at",
    ).withColumn("period", F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir, chunk_targets(spark, sf_dir)).select("ref_table", "period", "ref_key", "target_id")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = chunk_targets(spark, sf_dir)
    return orphan_report(classify_orphans(_orphans(spark, sf_dir, targets), targets, "target_id", "deleted"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}

_UUID_SQL = """(CASE WHEN regexp_matches(lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13))), '^\\{{?\\s*[0-9a-f]{{8}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{4}}-?[0-9a-f]{{12}}\\s*\\}}?$')
 THEN nullif(CAST(CAST(regexp_replace(lower({0}), '[^0-9a-f]', '', 'g') AS UUID) AS VARCHAR), '00000000-0000-0000-0000-000000000000') END)"""


def _uuid_sql(column: str) -> str:
    return _UUID_SQL.format(column)


_BASE = f"""
WITH chunks AS (SELECT id, any_value(related_ids) AS related_ids, min(created_at) AS created_at FROM tmp_chunks_upload GROUP BY id),
logs AS (SELECT id, any_value({_uuid_sql('resource_id')}) AS rid, any_value(action) AS action, min(created_at) AS created_at FROM kb_audit_logs
  WHERE action IN ('chunk.delete', 'chunk.restore') AND resource_type = 'chunk' AND outcome = 'success' GROUP BY id),
ranked AS (SELECT rid, action, row_number() OVER (PARTITION BY rid ORDER BY created_at DESC, id DESC) AS n FROM logs),
gone AS (SELECT rid FROM ranked WHERE n = 1 AND action = 'chunk.delete'),
refs AS (
  SELECT DISTINCT 'tmp_chunks_upload' AS ref_table, id AS ref_key, {_uuid_sql('t')} AS target_id, created_at
  FROM (SELECT id, created_at, unnest(CAST(json(CASE WHEN json_valid(related_ids) AND json_type(related_ids) = 'ARRAY' THEN related_ids END) AS VARCHAR[])) AS t FROM chunks)
  UNION ALL
  SELECT 'tmp_kg_triples_upload', CAST(id AS VARCHAR), any_value({_uuid_sql('source_chunk')}), min(created_at) FROM tmp_kg_triples_upload GROUP BY id
  UNION ALL
  SELECT 'tmp_chunk_relations_upload', CAST(id AS VARCHAR), any_value({_uuid_sql('dst_id')}), min(created_at) FROM tmp_chunk_relations_upload GROUP BY id),
cases AS (
  SELECT ref_table, strftime(r.created_at AT TIME ZONE 'UTC', '%Y-%m') AS period, ref_key, r.target_id,
    CASE WHEN c.id IS NULL THEN 'missing' WHEN gone.rid IS NOT NULL THEN 'deleted'
         WHEN c.created_at > r.created_at + INTERVAL 48 HOURS THEN 'late' END AS reason
  FROM refs r LEFT JOIN chunks c ON c.id = r.target_id LEFT JOIN gone ON gone.rid = r.target_id
  WHERE r.target_id IS NOT NULL)
"""

SQL = {
    "p4_found": _BASE + "SELECT ref_table, period, ref_key, target_id FROM cases WHERE reason IS NOT NULL",
    "p4_report": _BASE
    + "SELECT ref_table, period, reason, count(*) AS orphans, count(DISTINCT target_id) AS targets FROM cases WHERE reason IS NOT NULL GROUP BY ALL",
}
