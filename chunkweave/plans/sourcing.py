"""Queries of readers, writers and model-answer tables, fed from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.operators import enrich, merge
from chunkweave.plans import analytics as _analytics
from chunkweave.plans import retrieval as _retrieval
from chunkweave.plans._tables import BLOCKS, CHUNKS, blocks, chunks
from chunkweave.runtime import first_rows, table
from chunkweave.sources import readers, writers


def file_hashes(spark, sf_dir):
    own = chunks(spark, sf_dir, "content")
    return own.select("id", writers.file_hash(F.coalesce("content", F.lit("")).cast("binary")).alias("hash"))


def content_list(spark, sf_dir):
    """Chunks written as a parser's content list and read again."""
    own = chunks(spark, sf_dir, "content", "page", "layer", "is_table_chunk", "is_image_chunk", "image_path")
    kind = F.when(F.col("layer") == "enhanced", "page_number").when(F.col("is_table_chunk"), "Table").when(F.col("is_image_chunk"), "image").when(F.col("layer") == "parent", "header").otherwise("odd")
    entry = F.struct(kind.alias("type"), F.col("content").alias("text"), F.col("page").alias("page_idx"), F.col("image_path").alias("img_path"))
    payload = own.select("id", F.to_json(F.array(entry)).alias("payload"))
    found = readers.content_list_blocks(payload, "id", "payload")
    return found.select(F.col("doc_id").alias("id"), "type", F.md5("text").alias("text"), "page_idx", "is_table")


def markdown_kinds(spark, sf_dir):
    """Blocks of each kind in every text read as markdown."""
    documents = first_rows(table(spark, sf_dir, "documents").select("doc_id", "text", "created_at"), "doc_id", "created_at")
    return readers.markdown_blocks(documents, "doc_id", "text").groupBy("doc_id", "type").agg(F.count("*").alias("blocks"))


_URL = "CASE doc_id % 6 WHEN 0 THEN 'https://site' || doc_id || '.example/a?b' WHEN 1 THEN 'http://127.0.0.1:80/' || doc_id WHEN 2 THEN 'http://10.0.0.7/' || doc_id WHEN 3 THEN 'ftp://x' || doc_id WHEN 4 THEN 'HTTP://LOCALHOST/' || doc_id ELSE 'http://u:p@172.20.1.1/' || doc_id END"


def public_addresses(spark, sf_dir):
    urls = table(spark, sf_dir, "documents").select("doc_id", F.expr(_URL).alias("url"))
    return urls.filter(readers.is_public_url("url")).select("doc_id", "url").distinct()


def shard_merge(spark, sf_dir):
    """Blocks parsed in ranges of ten pages, put together again."""
    own = blocks(spark, sf_dir).filter("page_idx IS NOT NULL").withColumn("shard_no", F.floor(F.col("page_idx") / 10).cast("int")).withColumn("page_idx", F.col("page_idx") % 10)
    shards = own.select("doc_id", "shard_no").distinct().withColumn("start_page", F.col("shard_no") * 10)
    return enrich.merge_shards(own, shards).select("id", "doc_id", "page_idx", "block_pos")


def recall_channels(spark, sf_dir):
    scored = _retrieval._base(spark, sf_dir).withColumn("score", F.greatest(F.coalesce("dense_score", F.lit(0.0)), F.coalesce("sparse_score", F.lit(0.0))))
    return enrich.recall_channels(scored)


def chunk_triples(spark, sf_dir):
    """A triple for every enhanced chunk, owned by the chunk that it enhances."""
    triple = F.struct(F.coalesce("title", F.lit("")).alias("s"), F.lit("in").alias("p"), F.coalesce("source", F.lit("")).alias("o"), F.lit(0.7).alias("confidence"))
    own = chunks(spark, sf_dir, "kb_id", "layer", "parent_id", "title", "source").withColumn("triples", F.array(triple))
    return enrich.triples_of(own)


def layered_settings(spark, sf_dir):
    bases = table(spark, sf_dir, "knowledge_bases")
    wanted = bases.select(F.col("id").alias("key"), F.lit("none").alias("default"))
    first = bases.filter("deleted_at IS NULL AND status != 'active'").select(F.col("id").alias("key"), F.col("status").alias("value"))
    second = bases.filter("default_strategy IS NOT NULL").select(F.col("id").alias("key"), F.col("default_strategy").alias("value"))
    return readers.resolve_settings(wanted, first, second)


def version_log(spark, sf_dir):
    """Outcomes of each action as a setting that changes."""
    logs = first_rows(table(spark, sf_dir, "kb_audit_logs"), "id", "created_at")
    changed = merge.version_log(logs.select("id", "action", "outcome", "created_at"), "action", "outcome", "created_at", "id")
    return changed.select("id", "action", "outcome", F.coalesce("before", F.lit("")).alias("before"), "version")


def backup_rows(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "label")
    own = vectors.select("id", F.col("label").cast("string").alias("content"), (F.col("label") % 3).alias("page"), F.concat(F.lit('["'), "id", F.lit('", ""]')).alias("related_ids"))
    return writers.backup_rows(own, vectors, 64).select("schemaVersion", "id", "content", "page", "related_ids", F.size(F.from_json("embedding", "array<float>")).alias("numbers"))


QUERIES = {
    f.__name__: f
    for f in (file_hashes, content_list, markdown_kinds, public_addresses, shard_merge, recall_channels, chunk_triples, layered_settings, version_log, backup_rows)
}

SQL = {
    "file_hashes": f"SELECT id, sha256(coalesce(content, '')) AS hash FROM {CHUNKS}",
    "content_list": f"""SELECT id, CASE WHEN is_table_chunk THEN 'table' WHEN is_image_chunk THEN 'image' WHEN layer = 'parent' THEN 'title' ELSE 'text' END AS type, md5(coalesce(content, '')) AS text, coalesce(page, 0) AS page_idx,
  coalesce(is_table_chunk, false) AS is_table FROM {CHUNKS} WHERE layer IS DISTINCT FROM 'enhanced'""",
    "markdown_kinds": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY created_at) = 1),
l AS (SELECT doc_id, trim(unnest(string_split_regex(text, '\r\n|\n')), ' ') AS bare, unnest(range(len(string_split_regex(text, '\r\n|\n')))) AS k FROM d),
k AS (SELECT *, starts_with(bare, '|') AND ends_with(bare, '|') AND length(bare) > 0 AS bar FROM l),
r AS (SELECT *, bar AND NOT coalesce(lag(bar) OVER (PARTITION BY doc_id ORDER BY k), false) AS opens FROM k)
SELECT doc_id, type, count(*) AS blocks FROM (SELECT doc_id, CASE WHEN bar THEN 'table' WHEN regexp_matches(bare, '^#{1,6}\s+') THEN 'title' WHEN regexp_matches(bare, '^!\[[^\]]*\]\([^)]+\)') THEN 'image' ELSE 'text' END AS type FROM r WHERE opens OR (NOT bar AND bare <> '')) GROUP BY ALL""",
    "public_addresses": f"SELECT DISTINCT doc_id, {_URL} AS url FROM documents WHERE doc_id % 6 = 0",
    "shard_merge": f"""SELECT id, doc_id, page_idx, (row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, page_idx // 10, block_pos) - 1)::INT AS block_pos FROM {BLOCKS} WHERE page_idx IS NOT NULL""",
    "recall_channels": _retrieval._TWO
    + """ SELECT query_id, count(*) AS total, count(*) FILTER (WHERE d > 0) AS dense, count(*) FILTER (WHERE coalesce(d, 0) = 0) AS other, count(*) FILTER (WHERE greatest(coalesce(d, 0), coalesce(s, 0)) <= 0.3) AS related
FROM (SELECT coalesce(h.query_id, t.query_id) AS query_id, h.score AS d, t.score AS s FROM hits h FULL JOIN titles t ON h.query_id = t.query_id AND h.id = t.id) GROUP BY query_id""",
    "chunk_triples": f"SELECT kb_id, coalesce(title, '') AS s, 'in' AS p, coalesce(source, '') AS o, 0.7::DOUBLE AS confidence, coalesce(parent_id, id) AS source_chunk FROM {CHUNKS} WHERE layer = 'enhanced'",
    "layered_settings": """SELECT id AS key, CASE WHEN deleted_at IS NULL AND status <> 'active' THEN status ELSE coalesce(default_strategy, 'none') END AS value,
  CASE WHEN deleted_at IS NULL AND status <> 'active' THEN 'layer1' WHEN default_strategy IS NOT NULL THEN 'layer2' ELSE 'default' END AS source FROM knowledge_bases""",
    "version_log": f"""SELECT id, action, outcome, coalesce(before, '') AS before, row_number() OVER (PARTITION BY action ORDER BY created_at, id)::INT AS version FROM (
  SELECT *, lag(outcome) OVER (PARTITION BY action ORDER BY created_at, id) AS before FROM {_analytics._LOGS}) WHERE before IS NULL OR before IS DISTINCT FROM outcome""",
    "backup_rows": """SELECT '1' AS schemaVersion, vec_id::VARCHAR AS id, label::VARCHAR AS content, label % 3 + 1 AS page, '["' || vec_id || '"]' AS related_ids, len(embedding)::INT AS numbers FROM embeddings""",
}
