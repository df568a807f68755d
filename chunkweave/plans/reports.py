"""Queries of the small projections and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.operators import reports
from chunkweave.plans import analytics, chunking, retrieval
from chunkweave.plans._tables import BLOCKS, CHUNKS, RELATIONS, blocks, chunks, relations
from chunkweave.runtime import first_rows, table

_NOW = "2026-06-01 00:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp")


def _logs(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "kb_audit_logs"), "id", "created_at")


def candidate_view(spark, sf_dir):
    own = chunks(spark, sf_dir, "content", "source", "document_id", "page", "chunk_index", "layer", "parent_id", "title", "is_image_chunk", "is_table_chunk", "image_path")
    view = reports.candidate_view(own)
    return view.select("id", F.md5("content").alias("content"), "source", "document_id", "document_name", "page", "chunk_index", "location", "layer", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "score", "is_image_chunk")


def media_answers(spark, sf_dir):
    own = chunks(spark, sf_dir, "source", "page", "chunk_index")
    hits = retrieval.media_reference(spark, sf_dir).join(own, "id")
    asked = retrieval._asking_figures(spark, sf_dir).filter("text != ''").select("query_id", F.col("text").alias("label"))
    return reports.media_answers(asked, hits).withColumn("chunk_id", F.coalesce("chunk_id", F.lit("")))


def relation_filters(spark, sf_dir):
    """Chunks with their relations of two kinds, and whether one of them leads back to the chunk."""
    own = relations(spark, sf_dir).filter("dst_id IS NOT NULL").groupBy("src_id").agg(F.collect_list(F.struct("dst_id", "rel_type")).alias("r"))
    kept = reports.of_types(F.col("r"), ["refers_to", "sibling"])
    return own.select("src_id", F.size(kept).alias("kept"), reports.has_relation(F.col("r"), F.col("src_id")).alias("to_itself"))


def page_counts(spark, sf_dir):
    return reports.page_counts(blocks(spark, sf_dir))


def freshness(spark, sf_dir):
    rows = table(spark, sf_dir, "knowledge_bases").select("tenant_id", "created_at", "deleted_at")
    found = reports.freshness(rows, ["tenant_id"], ["created_at", "deleted_at"], _now(), 300 * 86400)
    return found.select(F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), "age_seconds", "reason")


def newest_runs(spark, sf_dir):
    return reports.newest(table(spark, sf_dir, "embedding_run").select("run_id", "created_at"), 200, "created_at", key="run_id").select("run_id")


def log_metrics(spark, sf_dir):
    counted = {"deletes": r"chunk\.delete", "denied": "denied"}
    return reports.log_metrics(_logs(spark, sf_dir).withColumn("line", F.concat_ws(" ", "summary", "metadata")), "action", "line", counted, {"attempts": r'"attempt": (\d{1,9})'})


def log_progress(spark, sf_dir):
    lines = _logs(spark, sf_dir).withColumn("n", F.nullif(F.regexp_extract(F.coalesce("metadata", F.lit("")), r'"attempt": (\d{1,9})', 1), F.lit("")).cast("bigint"))
    return reports.running_maximum(lines, "resource_type", ["created_at", "id"], F.col("n")).select("id", F.coalesce("progress", F.lit(0)).alias("progress"))


def submission_order(spark, sf_dir):
    pages = chunking.page_weight(spark, sf_dir).withColumnRenamed("page_idx", "shard_no")
    return reports.submission_order(pages).select("doc_id", "shard_no", "turn")


def running_totals(spark, sf_dir):
    return reports.running_totals(chunking.page_weight(spark, sf_dir), "doc_id", "page_idx", "weight").select("doc_id", "page_idx", "before")


def merged_usage(spark, sf_dir):
    calls = analytics._calls(spark, sf_dir).withColumn("counters", F.create_map(F.col("stage"), F.col("tokens"), F.lit("calls"), F.lit(1).cast("bigint")))
    merged = reports.merged_usage(calls, "kb_id", "counters")
    return merged.select("kb_id", F.explode("counters").alias("name", "n"))


def unexpired(spark, sf_dir):
    return reports.unexpired(_logs(spark, sf_dir), "created_at", _now(), 90 * 86400).select("id")


def log_export(spark, sf_dir):
    return reports.log_export(_logs(spark, sf_dir), ["id", "action", "actor_id", "outcome", "summary"], "created_at", "id")


def hourly_series(spark, sf_dir):
    now = F.lit("2024-01-20 13:20:00").cast("timestamp")
    return reports.hourly_series(analytics._calls(spark, sf_dir), "created_at", now, 24, "tokens").select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "calls", "tokens")


QUERIES = {
    f.__name__: f
    for f in (
        candidate_view, media_answers, relation_filters, page_counts, freshness, newest_runs, log_metrics, log_progress, submission_order, running_totals, merged_usage, unexpired,
        log_export, hourly_series,
    )
}

_LOGS = analytics._LOGS
_LINE = "concat_ws(' ', summary, metadata)"
_ATTEMPT = "nullif(regexp_extract(coalesce({0}, ''), '\"attempt\": (\\d{{1,9}})', 1), '')::BIGINT"
_SAFE = "CASE WHEN regexp_matches({0}::VARCHAR, '^[=+\\-@\\t\\r]') THEN '''' || {0}::VARCHAR ELSE coalesce({0}::VARCHAR, '') END AS {0}"
_NOW_SQL = f"TIMESTAMPTZ '{_NOW}+00'"

SQL = {
    "candidate_view": f"""SELECT id, md5(coalesce(content, '')) AS content, coalesce(source, '') AS source, coalesce(document_id, '') AS document_id, coalesce(source, '') AS document_name, coalesce(page, 0) AS page,
  coalesce(chunk_index, 0) AS chunk_index, 'P.' || coalesce(page, 0) || ' · #' || (coalesce(chunk_index, 0) + 1) AS location, coalesce(layer, '') AS layer, coalesce(parent_id, '') AS parent_id, 0.0::DOUBLE AS score, coalesce(is_image_chunk, false) AS is_image_chunk FROM {CHUNKS}""",
    "media_answers": "WITH " + retrieval._Q + "," + retrieval._MEDIA
    + f""", best AS (SELECT m.query_id, c.id, source, page, chunk_index FROM media m JOIN {CHUNKS} c ON c.id = m.id QUALIFY row_number() OVER (PARTITION BY m.query_id ORDER BY score DESC, m.id) = 1)
SELECT n.query_id, CASE WHEN b.id IS NULL THEN '根据现有文档无法回答该问题' ELSE '已定位到 ' || x || '，来源：' || coalesce(source, '') || '，位置：P.' || coalesce(page, 0) || coalesce(' · #' || (chunk_index + 1), '') || '。[1]' END AS answer,
  coalesce(b.id, '') AS chunk_id, b.id IS NULL AS cannot_answer FROM named n LEFT JOIN best b USING (query_id) WHERE x <> ''""",
    "relation_filters": f"""SELECT src_id, (count(*) FILTER (WHERE rel_type IN ('refers_to', 'sibling')))::INT AS kept, bool_or(dst_id = src_id) AS to_itself FROM {RELATIONS} WHERE dst_id IS NOT NULL GROUP BY src_id""",
    "page_counts": f"SELECT doc_id, coalesce(max(page_idx) + 1, 0)::INT AS pages FROM {BLOCKS} GROUP BY doc_id",
    "freshness": f"""SELECT coalesce(tenant_id, '') AS tenant_id, greatest(floor(epoch({_NOW_SQL})) - floor(epoch(ts)), 0)::BIGINT AS age_seconds,
  CASE WHEN ts IS NULL THEN 'missing' WHEN floor(epoch({_NOW_SQL})) - floor(epoch(ts)) > {300 * 86400} THEN 'stale' ELSE '' END AS reason FROM (
  SELECT tenant_id, max(greatest(created_at, deleted_at)) AS ts FROM knowledge_bases GROUP BY tenant_id)""",
    "newest_runs": "SELECT run_id FROM embedding_run ORDER BY created_at DESC NULLS LAST, run_id DESC LIMIT 200",
    "log_metrics": f"""SELECT action, count(*) FILTER (WHERE regexp_matches({_LINE}, 'chunk\\.delete')) AS deletes, count(*) FILTER (WHERE regexp_matches({_LINE}, 'denied')) AS denied,
  coalesce(max({_ATTEMPT.format(_LINE)}), 0) AS attempts FROM {_LOGS} GROUP BY action""",
    "log_progress": f"SELECT id, coalesce(max({_ATTEMPT.format('metadata')}) OVER (PARTITION BY resource_type ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS progress FROM {_LOGS}",
    "submission_order": f"SELECT doc_id, page_idx AS shard_no, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, page_idx)::INT AS turn FROM ({chunking.SQL['page_weight']})",
    "running_totals": f"SELECT doc_id, page_idx, coalesce(sum(weight) OVER (PARTITION BY doc_id ORDER BY page_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM ({chunking.SQL['page_weight']})",
    "merged_usage": "WITH " + analytics._CALLS + " SELECT kb_id, name, sum(n)::BIGINT AS n FROM (SELECT kb_id, stage AS name, tokens AS n FROM calls UNION ALL SELECT kb_id, 'calls', 1 FROM calls) WHERE n >= 0 GROUP BY ALL",
    "unexpired": f"SELECT id FROM {_LOGS} WHERE epoch_us({_NOW_SQL}) - epoch_us(created_at) <= {90 * 86400}::BIGINT * 1000000",
    "log_export": f"SELECT {', '.join(_SAFE.format(c) for c in ('id', 'action', 'actor_id', 'outcome', 'summary'))} FROM (SELECT * FROM {_LOGS} ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 100000)",
    "hourly_series": "WITH " + analytics._CALLS
    + """, hours AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-19 14:00:00', TIMESTAMP '2024-01-20 13:00:00', INTERVAL 1 HOUR)) AS h)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, count(c.id) AS calls, coalesce(sum(tokens), 0)::BIGINT AS tokens FROM hours LEFT JOIN calls c ON date_trunc('hour', c.created_at) = h GROUP BY h""",
}
