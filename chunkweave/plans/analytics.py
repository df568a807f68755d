"""Usage analytics, listings, merges and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.operators import merge, usage
from chunkweave.plans._tables import CHUNKS, RELATIONS, TRIPLES, chunks, relations, strip_sql, triples
from chunkweave.runtime import first_rows, table
from chunkweave.sources import writers


def _calls(spark, sf_dir):
    """The event stream as a log of calls."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.col("user_id").cast("string").alias("api_key_id"),
        F.col("event_type").alias("stage"),
        (F.col("user_id") % 5).cast("string").alias("kb_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        F.when(F.col("event_type") != "view", F.col("value")).otherwise(0.0).alias("latency_ms"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
    )


_CALLS = """calls AS (SELECT event_id AS id, ts AS created_at, CAST(user_id AS VARCHAR) AS api_key_id, event_type AS stage, CAST(user_id % 5 AS VARCHAR) AS kb_id,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, CASE WHEN event_type <> 'view' THEN value ELSE 0.0 END AS latency_ms,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events)"""


def hourly_rollup(spark, sf_dir):
    return usage.hourly_rollup(_calls(spark, sf_dir), ["kb_id", "stage"])


def rebuilt_hours(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    half = usage.hourly_rollup(calls.filter("id % 2 = 0"), ["kb_id"])
    return usage.rebuild_hours(half, calls, ["kb_id"], "2024-01-05 00:10:00", "2024-01-06 12:30:00")


def usage_breakdown(spark, sf_dir):
    return usage.usage_breakdown(_calls(spark, sf_dir), ["stage", "kb_id", "api_key_id"])


def stage_placeholders(spark, sf_dir):
    by_stage = _calls(spark, sf_dir).groupBy("stage").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return usage.expected_stages(by_stage, ["parse", "view", "click", "embed"])


def quota_windows(spark, sf_dir):
    calls = usage.quota_windows(_calls(spark, sf_dir), "api_key_id", "created_at", "1 day", 3, "id")
    return calls.groupBy("api_key_id", "window_start").agg(F.count("*").alias("calls"), F.count_if("allowed").alias("allowed"))


def nonce_dedup(spark, sf_dir):
    return usage.replayed(_calls(spark, sf_dir), ["api_key_id", "stage"], "created_at", "id", 3600).filter("replay").select("id")


def audit_filter(spark, sf_dir):
    logs = first_rows(table(spark, sf_dir, "kb_audit_logs"), "id", "created_at")
    hit = usage.log_filter(logs, "2025-01-01", "2026-01-01", outcome="success", resource_type="chunk", tenant_id=None)
    return hit.select("id", "action", "actor_id")


def audit_health(spark, sf_dir):
    logs = first_rows(table(spark, sf_dir, "kb_audit_logs"), "id", "created_at")
    return usage.health_counts(logs, "action", "outcome", "created_at", "2026-06-01 00:00:00", 7200)


def kb_listing(spark, sf_dir):
    documents = first_rows(table(spark, sf_dir, "kb_documents"), "id", "created_at")
    listed = usage.base_listing(table(spark, sf_dir, "knowledge_bases"), documents)
    return listed.withColumn("last_updated", F.coalesce(F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"), F.lit("")))


def dashboard_recent(spark, sf_dir):
    documents = first_rows(table(spark, sf_dir, "kb_documents"), "id", "created_at").select("id", "filename", "updated_at")
    top = usage.page_of(documents, [F.desc_nulls_last("updated_at"), "id"], 1, 10)
    return top.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


def page_of_documents(spark, sf_dir):
    documents = first_rows(table(spark, sf_dir, "kb_documents"), "id", "created_at").select("id", "filename")
    return usage.page_of(documents, ["filename", "id"], 2, 10)


def stale_counts(spark, sf_dir):
    """Documents whose stored number of chunks isn't what is there."""
    documents = first_rows(table(spark, sf_dir, "kb_documents"), "id", "created_at").select("id", "chunk_count")
    there = chunks(spark, sf_dir, "document_id").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("there"))
    joined = documents.join(there, "id", "left").select("id", F.coalesce("chunk_count", F.lit(-1)).alias("stored"), F.coalesce("there", F.lit(0)).alias("there"))
    return joined.filter("stored != there")


def search_text(spark, sf_dir):
    own = chunks(spark, sf_dir, "title", "content", "source")
    return own.select("id", F.md5(writers.search_text()).alias("search_text"))


def doc_export(spark, sf_dir):
    documents = first_rows(table(spark, sf_dir, "kb_documents"), "id", "created_at")
    own = chunks(spark, sf_dir, "document_id", "chunk_index", "page", "layer", "title", "content", "related_ids")
    out = writers.document_export(documents, own, relations(spark, sf_dir), triples(spark, sf_dir))
    return out.withColumn("content", F.md5("content")).select("document_id", "filename", "id", "page", "title", "content", "related_ids", "relations", "triples")


def draft_merge(spark, sf_dir):
    own = chunks(spark, sf_dir, "document_id", "page", "chunk_index", "content", "related_ids").filter("document_id IS NOT NULL")
    drafts = own.withColumn("related", F.from_json("related_ids", "array<string>"))
    merged = merge.merge_drafts(drafts, ["document_id", "page"], "chunk_index", "content", "related")
    return merged.select("document_id", "page", F.md5("content").alias("content"), F.size("related_ids").alias("related"), "drafts")


def latest_documents(spark, sf_dir):
    """Deliveries of each chunk merged: the earliest table brought up to date with the last delivery."""
    rows = table(spark, sf_dir, "tmp_chunk_relations_upload").select("src_id", "dst_id", "rel_type", "weight", "id", "created_at").filter("src_id IS NOT NULL AND dst_id IS NOT NULL")
    last = merge.latest(rows, ["src_id", "dst_id", "rel_type"], "created_at", "id")
    return last.select("src_id", "dst_id", "rel_type", "id")


def delta_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    current = orders.filter("o_orderkey % 10 < 8")
    changes = orders.filter("o_orderkey % 10 >= 6").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") + 1).alias("o_totalprice"))
    return merge.upsert(current, changes, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", F.round(F.coalesce("o_totalprice", F.lit(-1.0)), 2).alias("price"), F.coalesce("o_orderpriority", F.lit("")).alias("priority"))


def missing_rows(spark, sf_dir):
    """Triples that an insert would add to those of the first half of the ids."""
    own = triples(spark, sf_dir).select("kb_id", "s", "p", "o", "id").filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND kb_id IS NOT NULL")
    new = own.filter("id % 2 = 1").select("kb_id", "s", "p", "o")
    return merge.insert_missing(own.filter("id % 2 = 0"), new, ["kb_id", "s", "p", "o"])


def soft_delete(spark, sf_dir):
    bases = table(spark, sf_dir, "knowledge_bases").select("id", F.col("deleted_at").isNull().alias("active"))
    seen = table(spark, sf_dir, "kb_documents").select(F.col("kb_id").alias("id"))
    return merge.soft_delete(bases, seen, ["id"])


def cascade_delete(spark, sf_dir):
    """Rows left per table when the documents of one base go."""
    documents = first_rows(table(spark, sf_dir, "kb_documents"), "id", "created_at")
    own = chunks(spark, sf_dir, "document_id", "kb_id")
    placed = relations(spark, sf_dir).join(own.select(F.col("id").alias("src_id"), "document_id"), "src_id", "left").select("id", F.coalesce("document_id", F.lit("")).alias("document_id"))
    known = own.select("id", F.coalesce("document_id", F.lit("")).alias("document_id"))
    gone = documents.filter("kb_id = 'kb-0022' OR kb_id = 'default'").select("id")
    left = merge.cascade_delete(documents, gone, {"chunks": (known, "document_id"), "relations": (placed, "document_id")})
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {
    f.__name__: f
    for f in (
        hourly_rollup, rebuilt_hours, usage_breakdown, stage_placeholders, quota_windows, nonce_dedup, audit_filter, audit_health, kb_listing, dashboard_recent, page_of_documents,
        stale_counts, search_text, doc_export, draft_merge, latest_documents, delta_merge, missing_rows, soft_delete, cascade_delete,
    )
}

_DOCUMENTS = "(SELECT * FROM kb_documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"
_LOGS = "(SELECT * FROM kb_audit_logs QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"
_HOURLY = """SELECT date_trunc('hour', created_at) AS hour_bucket, coalesce(kb_id, '') AS kb_id{more}, count(*) AS request_count, coalesce(sum(tokens), 0)::BIGINT AS total_tokens,
  round(coalesce(sum(latency_ms), 0), 2) AS latency_ms_sum, count(*) FILTER (WHERE status <> 'success') AS error_count FROM calls WHERE {where} GROUP BY ALL"""
_RELATED = "CAST(json(CASE WHEN json_valid(related_ids) AND json_type(related_ids) = 'ARRAY' THEN related_ids END) AS VARCHAR[])"


def _sides(dimension: str, value: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, {value} AS value, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(coalesce(avg(nullif(latency_ms, 0)), 0), 4) AS avg_latency,
  round(count(*) FILTER (WHERE status = 'success')::DOUBLE / count(*), 4) AS success_rate FROM calls GROUP BY ALL"""


SQL = {
    "hourly_rollup": "WITH " + _CALLS + _HOURLY.format(more=", stage", where="true"),
    "rebuilt_hours": "WITH " + _CALLS + ", old AS (" + _HOURLY.format(more="", where="id % 2 = 0") + "), new AS (" + _HOURLY.format(more="", where="created_at >= '2024-01-05 00:00:00' AND created_at < '2024-01-06 13:00:00'")
    + ") SELECT * FROM old WHERE NOT (hour_bucket >= '2024-01-05 00:00:00' AND hour_bucket < '2024-01-06 13:00:00') UNION ALL SELECT * FROM new",
    "usage_breakdown": "WITH " + _CALLS + " UNION ALL ".join([_sides("all", "''"), _sides("stage", "stage"), _sides("kb_id", "kb_id"), _sides("api_key_id", "api_key_id")]),
    "stage_placeholders": "WITH " + _CALLS
    + """ SELECT coalesce(s.stage, w.stage) AS stage, coalesce(place, 4)::INT AS place, coalesce(calls, 0) AS calls, coalesce(tokens, 0)::BIGINT AS tokens, calls IS NULL AS placeholder
FROM (SELECT stage, count(*) AS calls, sum(tokens) AS tokens FROM calls GROUP BY stage) s FULL JOIN (VALUES ('parse', 0), ('view', 1), ('click', 2), ('embed', 3)) w(stage, place) ON s.stage = w.stage""",
    "quota_windows": "WITH " + _CALLS + " SELECT api_key_id, date_trunc('day', created_at)::TIMESTAMP AS window_start, count(*) AS calls, least(count(*), 3) AS allowed FROM calls GROUP BY ALL",
    "nonce_dedup": "WITH " + _CALLS + " SELECT id FROM (SELECT id, created_at, lag(created_at) OVER (PARTITION BY api_key_id, stage ORDER BY created_at, id) AS before FROM calls) WHERE created_at <= before + INTERVAL 1 HOUR",
    "audit_filter": f"SELECT id, action, actor_id FROM {_LOGS} WHERE outcome = 'success' AND resource_type = 'chunk' AND created_at BETWEEN TIMESTAMPTZ '2025-01-01 00:00:00+00' AND TIMESTAMPTZ '2026-01-01 00:00:00+00'",
    "audit_health": f"""SELECT action, count(*) AS total, count(*) FILTER (WHERE outcome = 'success') AS succeeded, count(*) FILTER (WHERE outcome <> 'success') AS failed,
  count(*) FILTER (WHERE outcome <> 'success' AND floor(epoch(TIMESTAMPTZ '2026-06-01 00:00:00+00')) - floor(epoch(created_at)) >= 7200) AS stale FROM {_LOGS} GROUP BY action""",
    "kb_listing": f"""SELECT b.id, name, status, coalesce(documents, 0) AS documents, coalesce(chunks, 0)::BIGINT AS chunks, coalesce(strftime(last_updated AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'), '') AS last_updated FROM knowledge_bases b LEFT JOIN (
  SELECT kb_id, count(*) AS documents, sum(chunk_count) AS chunks, max(updated_at) AS last_updated FROM {_DOCUMENTS} GROUP BY kb_id) d ON d.kb_id = b.id WHERE deleted_at IS NULL""",
    "dashboard_recent": f"SELECT id, filename, strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS updated_at FROM (SELECT * FROM {_DOCUMENTS} ORDER BY updated_at DESC NULLS LAST, id LIMIT 10)",
    "page_of_documents": f"SELECT id, filename FROM {_DOCUMENTS} ORDER BY filename COLLATE C NULLS FIRST, id LIMIT 10 OFFSET 10",
    "stale_counts": f"""SELECT d.id, coalesce(chunk_count, -1) AS stored, coalesce(there, 0) AS there FROM {_DOCUMENTS} d LEFT JOIN (SELECT document_id, count(*) AS there FROM {CHUNKS} GROUP BY 1) c
ON c.document_id = d.id WHERE coalesce(chunk_count, -1) <> coalesce(there, 0)""",
    "search_text": f"""SELECT id, md5(array_to_string(list_filter([{strip_sql("coalesce(title, '')")}, {strip_sql("coalesce(content, '')")}, {strip_sql("coalesce(source, '')")}], lambda x: x <> ''), ' ')) AS search_text FROM {CHUNKS}""",
    "doc_export": f"""
SELECT document_id, filename, c.id, coalesce(page, 0) + 1 AS page, coalesce(title, '') AS title, md5(content) AS content,
  CASE WHEN {_RELATED} IS NOT NULL THEN CAST(to_json(list_filter({_RELATED}, lambda x: trim(coalesce(x, '')) <> '')) AS VARCHAR)
       WHEN trim(coalesce(related_ids, '')) IN ('', 'null') THEN '[]' ELSE CAST(to_json([trim(related_ids)]) AS VARCHAR) END AS related_ids,
  coalesce(r.n, 0) AS relations, coalesce(t.n, 0) AS triples
FROM {CHUNKS} c JOIN {_DOCUMENTS} d ON d.id = c.document_id LEFT JOIN (SELECT src_id, count(*) AS n FROM {RELATIONS} GROUP BY 1) r ON r.src_id = c.id
LEFT JOIN (SELECT source_chunk, count(*) AS n FROM {TRIPLES} GROUP BY 1) t ON t.source_chunk = c.id""",
    "draft_merge": f"""
SELECT document_id, page, md5(string_agg(CASE WHEN trim(coalesce(content, ''), ' ') <> '' THEN trim(content, ' ') END, chr(10) || chr(10) ORDER BY chunk_index)) AS content,
  len(list_distinct(flatten(list(coalesce({_RELATED}, []))))) + CASE WHEN len(list_filter(flatten(list(coalesce({_RELATED}, []))), lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END AS related, count(*)::INT AS drafts
FROM {CHUNKS} WHERE document_id IS NOT NULL GROUP BY document_id, page""",
    "latest_documents": """SELECT src_id, dst_id, rel_type, id FROM tmp_chunk_relations_upload WHERE src_id IS NOT NULL AND dst_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY src_id, dst_id, rel_type ORDER BY created_at DESC, id DESC) = 1""",
    "delta_merge": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 >= 6 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  round(CASE WHEN o_orderkey % 10 >= 6 AND o_orderkey % 2 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 10 < 8 THEN o_totalprice ELSE -1 END, 2) AS price,
  CASE WHEN o_orderkey % 10 < 8 THEN o_orderpriority ELSE '' END AS priority FROM orders""",
    "missing_rows": f"""WITH t AS (SELECT * FROM {TRIPLES} WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND kb_id IS NOT NULL)
SELECT DISTINCT kb_id, s, p, o FROM t WHERE id % 2 = 1 AND (kb_id, s, p, o) NOT IN (SELECT (kb_id, s, p, o) FROM t WHERE id % 2 = 0)""",
    "soft_delete": "SELECT id, deleted_at IS NULL AND id IN (SELECT kb_id FROM kb_documents) AS active FROM knowledge_bases",
    "cascade_delete": f"""WITH gone AS (SELECT id FROM {_DOCUMENTS} WHERE kb_id IN ('kb-0022', 'default'))
SELECT 'documents' AS table_name, count(*) AS rows FROM {_DOCUMENTS} WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'chunks', count(*) FROM {CHUNKS} WHERE coalesce(document_id, '') NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'relations', count(*) FROM {RELATIONS} r LEFT JOIN {CHUNKS} c ON c.id = r.src_id WHERE coalesce(c.document_id, '') NOT IN (SELECT id FROM gone)""",
}
