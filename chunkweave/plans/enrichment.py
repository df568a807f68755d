"""Routing, parsing of model answers, block de-duplication and page routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.operators import enrich
from chunkweave.plans import chunking as _chunking
from chunkweave.plans import retrieval as _retrieval
from chunkweave.plans._tables import BLOCKS, CHUNKS, TRIPLES, blocks, chunks, triples
from chunkweave.sources import readers


def enhancement_kinds(spark, sf_dir):
    own = chunks(spark, sf_dir, "content", "layer", "is_table_chunk", "is_image_chunk").filter("layer = 'child'")
    return own.select("id", enrich.enhancement_kind(own).alias("kind"))


def enhanced_parse(spark, sf_dir):
    """Triples written as fenced JSON with a trailing comma and parsed again."""
    own = triples(spark, sf_dir)
    body = F.to_json(F.struct(F.col("s").alias("summary"), F.array(F.struct("s", "p", "o", "confidence")).alias("triples")))
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace(body, r"\]\}$", "],}"), F.lit("\n```"))
    parsed = own.select("id", enrich.parse_enhanced(answer).alias("e")).select("id", F.explode("e.triples").alias("t"))
    return parsed.select("id", "t.s", "t.p", "t.o", F.round("t.confidence", 6).alias("confidence"))


def page_routes(spark, sf_dir):
    return enrich.page_routes(_chunking._pages(spark, sf_dir)).select("doc_id", "page_idx", "route", "reason")


def route_summary(spark, sf_dir):
    return enrich.route_summary(enrich.page_routes(_chunking._pages(spark, sf_dir)))


def distinct_blocks(spark, sf_dir):
    """The first block of each text on a page."""
    own = blocks(spark, sf_dir).filter("doc_id != ''")
    return readers.distinct_blocks(own).select("id", "doc_id")


def rerank_topk(spark, sf_dir):
    """Candidates rescored by an outside score where there is one: shorter texts first."""
    hits = _retrieval._hits(spark, sf_dir).select("query_id", "id", "score")
    own = chunks(spark, sf_dir, "content", "layer").filter("layer = 'child'").select("id", F.round(1 / (1 + F.length("content")), 9).alias("rerank_score"))
    scores = hits.select("query_id", "id").join(own, "id")
    return enrich.rerank(hits, scores, 5).select("query_id", "id", F.col("final"), "rank")


QUERIES = {f.__name__: f for f in (enhancement_kinds, enhanced_parse, page_routes, route_summary, distinct_blocks, rerank_topk)}

_PAGES = _chunking._PAGES
_ROUTES = f"""(SELECT *, CASE WHEN reason IN ('scanned', 'many_images') THEN 'cloud' WHEN reason = 'plain_text' THEN 'local' ELSE 'uncertain' END AS route FROM (
  SELECT *, CASE WHEN text_chars < 20 AND image_count > 0 THEN 'scanned' WHEN text_chars < 80 THEN 'little_text' WHEN image_count > 2 THEN 'many_images' WHEN drawing_count > 20 THEN 'many_drawings' ELSE 'plain_text' END AS reason FROM {_PAGES}))"""

SQL = {
    "enhancement_kinds": f"""SELECT id, CASE WHEN is_image_chunk THEN 'image' WHEN is_table_chunk THEN 'table'
  WHEN length(coalesce(content, '')) < 80 OR regexp_matches(left(coalesce(content, ''), 400), '{enrich.FRAGMENT_WORDS}') THEN 'fragment' ELSE 'text' END AS kind FROM {CHUNKS} WHERE layer = 'child'""",
    "enhanced_parse": f"""SELECT id, s, p, o, round(least(greatest(coalesce(confidence::DOUBLE, 0.7), 0), 1), 6) AS confidence FROM {TRIPLES}
WHERE trim(coalesce(s, '')) <> '' AND trim(coalesce(p, '')) <> '' AND trim(coalesce(o, '')) <> ''""",
    "page_routes": f"SELECT doc_id, page_idx, route, reason FROM {_ROUTES}",
    "route_summary": f"""SELECT doc_id, count(*) FILTER (WHERE route = 'local') AS local_pages, count(*) FILTER (WHERE route = 'cloud') AS cloud_pages, count(*) FILTER (WHERE route = 'uncertain') AS uncertain_pages,
  round(count(*) FILTER (WHERE route = 'local')::DOUBLE / count(*), 4) AS local_share,
  CASE WHEN count(*) FILTER (WHERE route = 'local')::DOUBLE / count(*) >= 0.5 THEN 'hybrid' WHEN count(*) FILTER (WHERE route = 'local')::DOUBLE / count(*) >= 0.2 THEN 'trial' ELSE 'cloud' END AS advice FROM {_ROUTES} GROUP BY doc_id""",
    "distinct_blocks": f"""SELECT id, doc_id FROM {BLOCKS} WHERE doc_id <> ''
QUALIFY row_number() OVER (PARTITION BY doc_id, type, page_idx, image_path, trim(coalesce(text, ''), ' ') ORDER BY block_pos) = 1""",
    "rerank_topk": _retrieval._HITS
    + f""" SELECT query_id, id, final, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS rank FROM (
  SELECT query_id, h.id, CASE WHEN layer = 'child' THEN coalesce(round(1 / (1 + length(content))::DOUBLE, 9), score) ELSE score END AS final FROM hits h JOIN {CHUNKS} c ON c.id = h.id)) WHERE rank <= 5""",
}
