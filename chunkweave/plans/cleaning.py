"""Cleaning rules and the quality gate over the chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.operators import clean
from chunkweave.plans._tables import BLOCKS, CHUNKS, blocks, chunks, strip_sql


def _cleaned(spark, sf_dir):
    return clean.clean_blocks(blocks(spark, sf_dir))


def clean_removed_by_rule(spark, sf_dir):
    return clean.removed_by_rule(_cleaned(spark, sf_dir))


def clean_kept_blocks(spark, sf_dir):
    return _cleaned(spark, sf_dir).filter("removed_by IS NULL").select("id", "doc_id", "block_pos", "type")


def clean_previews(spark, sf_dir):
    return clean.removed_previews(_cleaned(spark, sf_dir))


def quality_gate(spark, sf_dir):
    own = chunks(spark, sf_dir, "kb_id", "content", "is_table_chunk", "is_image_chunk")
    gated = clean.quality_gate(own, "content", max_punct=0.15)
    return gated.groupBy("kb_id").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("discarded"))


def structured_filter(spark, sf_dir):
    """Metadata retrieval: base, layers, tables and a page range.

    All deliveries of a chunk agree in these columns, so the filter goes to the scan and only its rows are de-duplicated.
    """
    hit = (F.col("kb_id") == "default") & F.col("layer").isin("child", "enhanced") & F.col("page").between(2, 9) & F.col("is_table_chunk")
    own = chunks(spark, sf_dir, "kb_id", "document_id", "page", "chunk_index", "layer", "is_table_chunk", where=hit)
    return own.select("id", "document_id", "page", "chunk_index", F.lit(1.0).alias("score"))


QUERIES = {
    "clean_removed_by_rule": clean_removed_by_rule,
    "clean_kept_blocks": clean_kept_blocks,
    "clean_previews": clean_previews,
    "quality_gate": quality_gate,
    "structured_filter": structured_filter,
}

_NOTICE = "|".join(clean.NOTICES)
_RATIO = "length(regexp_replace({0}, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / nullif(length({0}), 0)::DOUBLE"
_CLEANED = f"""
WITH b AS (SELECT *, coalesce(text, '') AS t, {strip_sql("coalesce(text, '')")} AS s FROM {BLOCKS}),
first AS (SELECT *, CASE
    WHEN NOT is_table AND type <> 'image' AND length(s) < 3 THEN 'remove_empty'
    WHEN NOT is_table AND type <> 'image' AND type <> 'title' AND length(s) < 10 THEN 'remove_short'
    WHEN NOT is_table AND type <> 'image' AND s <> '' AND {_RATIO.format('t')} > 0.8 THEN 'remove_punctuation'
    WHEN type <> 'image' AND length(t) < 200 AND regexp_matches(t, '{_NOTICE}') THEN 'remove_copyright' END AS by_text FROM b),
cleaned AS (SELECT *, coalesce(by_text, CASE WHEN type = 'image' AND row_number() OVER (
    PARTITION BY type, by_text, doc_id, page_idx, coalesce(nullif(image_path, ''), s) ORDER BY block_pos) > 1 THEN 'remove_duplicate_images' END) AS removed_by FROM first)
"""

SQL = {
    "clean_removed_by_rule": _CLEANED + "SELECT removed_by, count(*) AS removed FROM cleaned WHERE removed_by IS NOT NULL GROUP BY 1",
    "clean_kept_blocks": _CLEANED + "SELECT id, doc_id, block_pos, type FROM cleaned WHERE removed_by IS NULL",
    "clean_previews": _CLEANED
    + "SELECT doc_id, block_pos, removed_by, CASE WHEN left(s, 60) = '' THEN coalesce(image_path, '') ELSE left(s, 60) END AS preview FROM cleaned WHERE removed_by IS NOT NULL",
    "quality_gate": f"""
SELECT kb_id, count(*) AS total, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS discarded FROM (
  SELECT kb_id, coalesce(is_table_chunk, false) OR coalesce(is_image_chunk, false) OR coalesce({_RATIO.format("coalesce(content, '')")} <= 0.15, true) AS ok FROM {CHUNKS})
GROUP BY kb_id""",
    "structured_filter": f"""
SELECT id, document_id, page, chunk_index, 1.0::DOUBLE AS score FROM {CHUNKS}
WHERE kb_id = 'default' AND layer IN ('child', 'enhanced') AND page BETWEEN 2 AND 9 AND is_table_chunk""",
}
