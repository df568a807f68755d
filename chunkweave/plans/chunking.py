"""Chunking strategies, statistics and shard planning over the chunk table seen as blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.operators import chunking
from chunkweave.plans._tables import BLOCKS, CHUNKS, blocks, chunks, strip_sql


def _known_page(parts):
    return parts.withColumn("page_idx", F.coalesce("page_idx", F.lit(-1)))


def chunk_fixed_length(spark, sf_dir):
    return _known_page(chunking.chunk(blocks(spark, sf_dir), "fixed_length", size=400, overlap=50))


def chunk_separator(spark, sf_dir):
    return _known_page(chunking.chunk(blocks(spark, sf_dir), "separator", separators=("\n\n", "\n", "。")))


def chunk_stats(spark, sf_dir):
    return chunking.chunk_stats(chunks(spark, sf_dir, "strategy", "content", "page", "is_table_chunk"))


def parse_stats(spark, sf_dir):
    return chunking.parse_stats(blocks(spark, sf_dir))


def chunk_paragraph(spark, sf_dir):
    return chunking.chunk(blocks(spark, sf_dir), "paragraph")


def chunk_semantic(spark, sf_dir):
    return chunking.chunk(blocks(spark, sf_dir), "semantic")


def chunk_hierarchical(spark, sf_dir):
    return chunking.chunk(blocks(spark, sf_dir), "hierarchical")


def column_reorder(spark, sf_dir):
    """Blocks placed alternately left and right, read column by column."""
    left = (F.col("block_pos") % 2) * 300.0
    box = F.when(F.col("block_pos") % 7 != 3, F.array(left, (F.col("block_pos") % 5) * 10.0, left + 280.0, (F.col("block_pos") % 5) * 10.0 + 9))
    own = blocks(spark, sf_dir).filter("doc_id != ''").withColumn("bbox", box)
    return chunking.reorder_columns(own).select("id", "doc_id", "read_pos")


def _pages(spark, sf_dir):
    own = blocks(spark, sf_dir).filter("doc_id != '' AND page_idx IS NOT NULL")
    pages = own.groupBy("doc_id", "page_idx").agg(
        F.coalesce(F.sum(F.when(F.col("type").isin("text", "title"), F.length("text"))), F.lit(0)).alias("text_chars"),
        F.count_if(F.col("type").isin("text", "title")).alias("text_blocks"),
        F.count_if(F.col("type") == "image").alias("image_count"),
        F.count_if(F.col("type") == "table").alias("drawing_count"),
    )
    return pages.withColumn("likely_scanned", (F.col("text_chars") < 20) & (F.col("image_count") > 0))


def page_weight(spark, sf_dir):
    return chunking.page_weights(_pages(spark, sf_dir)).select("doc_id", "page_idx", "weight")


def shard_plan(spark, sf_dir):
    return chunking.plan_shards(chunking.page_weights(_pages(spark, sf_dir)).select("doc_id", "page_idx", "weight"), 10)


def shard_summary(spark, sf_dir):
    return chunking.shard_summary(shard_plan(spark, sf_dir))


def page_ranges(spark, sf_dir):
    return chunking.page_runs(_pages(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (chunk_fixed_length, chunk_separator, chunk_stats, parse_stats, chunk_paragraph, chunk_semantic, chunk_hierarchical, column_reorder, page_weight, shard_plan, shard_summary, page_ranges)
}

_TEXTS = f"(SELECT *, coalesce(text, '') AS t FROM {BLOCKS} WHERE NOT is_table AND type <> 'image')"
# Tables and images are one part each: the text, or for an image without one the number of its page.
_MEDIA = f"""SELECT doc_id, block_pos, 0::INT AS part_no, coalesce(page_idx, -1) AS page_idx, CASE WHEN type = 'image' AND coalesce(text, '') = '' THEN '[图片 第' || (page_idx + 1) || '页]' ELSE coalesce(text, '') END AS content
FROM {BLOCKS} WHERE is_table OR type = 'image'"""
_PAGES = f"""(SELECT doc_id, page_idx, coalesce(sum(length(text)) FILTER (WHERE type IN ('text', 'title')), 0) AS text_chars,
  count(*) FILTER (WHERE type IN ('text', 'title')) AS text_blocks, count(*) FILTER (WHERE type = 'image') AS image_count,
  count(*) FILTER (WHERE type = 'table') AS drawing_count FROM {BLOCKS} WHERE doc_id <> '' AND page_idx IS NOT NULL GROUP BY ALL)"""


def _kept_parts(sep: str) -> str:
    """Parts of ``t`` that keep the separator at their end (the engine has no look-behind)."""
    return f"list_transform(range(len(string_split(t, {sep}))), lambda i: string_split(t, {sep})[i + 1] || CASE WHEN i + 1 < len(string_split(t, {sep})) THEN {sep} ELSE '' END)"


def _solid(parts: str) -> str:
    return f"list_filter({parts}, lambda x: {strip_sql('x')} <> '')"


_SEPARATED = "CASE " + " ".join(f"WHEN len({_solid(_kept_parts(s))}) > 1 THEN {_solid(_kept_parts(s))}" for s in ("(chr(10) || chr(10))", "chr(10)", "'。'")) + f" ELSE {_solid('[t]')} END"

SQL = {
    "chunk_fixed_length": f"""
SELECT doc_id, block_pos, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INT AS part_no, coalesce(page_idx, -1) AS page_idx, content FROM (
  SELECT id, doc_id, block_pos, page_idx, k, substring(t, (k * 350 + 1)::BIGINT, 400) AS content
  FROM {_TEXTS}, LATERAL (SELECT unnest(range(0, greatest(ceil((greatest(length(t), 1) - 400) / 350.0), 0)::BIGINT + 1)) AS k))
WHERE {strip_sql('content')} <> '' UNION ALL {_MEDIA}""",
    "chunk_separator": f"""
SELECT doc_id, block_pos, (i - 1)::INT AS part_no, coalesce(page_idx, -1) AS page_idx, {strip_sql('parts[i]')} AS content
FROM (SELECT *, {_SEPARATED} AS parts FROM {_TEXTS}), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) UNION ALL {_MEDIA}""",
    "chunk_stats": f"""
SELECT strategy, count(*) AS chunks, count(*) FILTER (WHERE is_table_chunk) AS tables, round(avg(length(coalesce(content, ''))), 2) AS avg_chars,
  min(length(coalesce(content, ''))) AS min_chars, max(length(coalesce(content, ''))) AS max_chars, count(DISTINCT page) AS pages
FROM {CHUNKS} GROUP BY strategy""",
    "parse_stats": f"""
SELECT doc_id, count(*) AS blocks, count(DISTINCT page_idx) AS pages, min(page_idx) AS first_page, max(page_idx) AS last_page,
  count(*) FILTER (WHERE type = 'text') AS text_blocks, count(*) FILTER (WHERE type = 'title') AS title_blocks,
  count(*) FILTER (WHERE type = 'table') AS table_blocks, count(*) FILTER (WHERE type = 'image') AS image_blocks FROM {BLOCKS} GROUP BY doc_id""",
    "column_reorder": f"""
SELECT id, doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_idx NULLS FIRST, bucket, y, block_pos) - 1)::INT AS read_pos FROM (
  SELECT *, CASE WHEN boxed THEN least(floor((x0 + 140.0) / max(CASE WHEN boxed THEN x0 + 280.0 END) OVER (PARTITION BY doc_id, page_idx) * 2), 1) ELSE 2 END AS bucket,
    CASE WHEN boxed THEN (block_pos % 5) * 10.0 ELSE 1e308 END AS y
  FROM (SELECT *, (block_pos % 2) * 300.0 AS x0, block_pos % 7 <> 3 AS boxed FROM {BLOCKS} WHERE doc_id <> ''))""",
    "page_weight": f"""
SELECT doc_id, page_idx, (1 + least(text_chars // 600, 6) + least(text_blocks // 8, 4) + least(image_count * 4, 16) + least(drawing_count // 4, 8)
  + CASE WHEN text_chars < 20 AND image_count > 0 THEN 8 ELSE 0 END)::INT AS weight FROM {_PAGES}""",
    "page_ranges": f"""
SELECT doc_id, min(page_idx) AS first_page, max(page_idx) AS last_page, count(*) AS pages FROM (
  SELECT doc_id, page_idx, page_idx - row_number() OVER (PARTITION BY doc_id ORDER BY page_idx) AS island FROM {_PAGES}) GROUP BY doc_id, island""",
}
