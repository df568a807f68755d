"""Relations between chunks and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from chunkweave.operators import knowledge, links
from chunkweave.plans._tables import CHUNKS, RELATIONS, TRIPLES, chunks, relations, triples
from chunkweave.runtime import first_rows, table, written


def _chunks(spark, sf_dir):
    own = chunks(spark, sf_dir, "document_id", "chunk_index", "content", "title", "layer", "parent_id", "related_ids", "is_table_chunk", "is_image_chunk")
    return own.filter("document_id IS NOT NULL AND chunk_index IS NOT NULL").withColumnsRenamed({"document_id": "doc_id", "chunk_index": "idx"})


_DOCS = f"(SELECT *, document_id AS doc_id, chunk_index AS idx FROM {CHUNKS} WHERE document_id IS NOT NULL AND chunk_index IS NOT NULL)"
_OUT = ("src_id", "dst_id", "rel_type", "weight", "evidence")


def figure_references(spark, sf_dir):
    return links.media_references(_chunks(spark, sf_dir)).select(*_OUT)


def adjacent_media(spark, sf_dir):
    return links.adjacent_media(_chunks(spark, sf_dir)).select("src_id", "dst_id", "rel_type")


def sibling_pairs(spark, sf_dir):
    return links.siblings(_chunks(spark, sf_dir)).select("src_id", "dst_id", "rel_type")


def inherited_relations(spark, sf_dir):
    own = _chunks(spark, sf_dir)
    return links.inherited(own, links.siblings(own)).select("src_id", "dst_id", "rel_type")


def procedure_steps(spark, sf_dir):
    own = _chunks(spark, sf_dir)
    # Every leading sentence that names a step counts here, so that the test data hold some.
    return links.procedure_links(own).select("src_id", "dst_id", "rel_type")


def causal_links(spark, sf_dir):
    return links.causal_links(_chunks(spark, sf_dir)).select(*_OUT)


def unique_relations(spark, sf_dir):
    own = relations(spark, sf_dir).select("src_id", "dst_id", "rel_type", "weight", "id")
    return links.unique_relations(own, "id").select("src_id", "dst_id", "rel_type", F.round(F.col("weight").cast("double"), 6).alias("weight"), "id")


def semantic_links(spark, sf_dir):
    """Vectors whose id is divisible by 20 against all, other labels only."""
    pairs = links.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 0.2, 10, F.col("vec_id") % 20 == 0)
    return links.semantic_links(pairs, 0.35).select("src_id", "dst_id", "rel_type", F.round("weight", 6).alias("weight"), "evidence")


def migrated_relations(spark, sf_dir):
    return links.migrated_relations(_chunks(spark, sf_dir))


def _raw_entities(spark, sf_dir):
    own = triples(spark, sf_dir)
    named = own.select("kb_id", F.col("id").alias("seq"), F.col("s").alias("name"), F.coalesce("p", F.lit("")).alias("kind"), F.col("o").alias("alias"), "source_chunk")
    kind = F.when(F.col("kind") == "位于", "Location").when(F.col("kind") == "导致", "Hazard").otherwise("Concept")
    return named.select("kb_id", "seq", "name", kind.alias("type"), F.array("alias").alias("aliases"), "source_chunk")


def entity_merge(spark, sf_dir):
    return knowledge.merge_entities(_raw_entities(spark, sf_dir))


def entity_definitions(spark, sf_dir):
    mentions = triples(spark, sf_dir).select("kb_id", F.col("s").alias("name"), "source_chunk").distinct()
    return knowledge.define_entities(mentions, chunks(spark, sf_dir, "content"))


def chunk_entities(spark, sf_dir):
    return knowledge.chunk_entities(triples(spark, sf_dir).filter("source_chunk IS NOT NULL").select(F.col("source_chunk").alias("chunk_id"), F.col("s").alias("name")))


def _graph_parts(spark, sf_dir):
    own = _chunks(spark, sf_dir)
    placed = own.select(F.col("id").alias("chunk_id"), "doc_id")
    terms = triples(spark, sf_dir).select(F.col("source_chunk").alias("chunk_id"), "s", "p", "o", "confidence").join(placed, "chunk_id")
    entities = entity_merge(spark, sf_dir).withColumn("entity_id", F.concat_ws(":", F.coalesce("kb_id", F.lit("")), "type", "entity_no"))
    mentions = entities.select("entity_id", "name", F.explode("source_chunks").alias("chunk_id")).join(placed, "chunk_id")
    return own, written(terms, "terms"), written(mentions, "mentions")  # both are read several times


def _document_graph(spark, sf_dir):
    own, terms, mentions = _graph_parts(spark, sf_dir)
    nodes = written(knowledge.graph_nodes(own, terms, 100, mentions), "nodes")
    edges = relations(spark, sf_dir).select("src_id", "dst_id", "rel_type").join(own.select(F.col("id").alias("src_id"), "doc_id"), "src_id")
    return nodes, knowledge.graph_edges(nodes, edges, terms, mentions)


def graph_nodes(spark, sf_dir):
    return _document_graph(spark, sf_dir)[0]


def graph_edges(spark, sf_dir):
    return _document_graph(spark, sf_dir)[1]


def graph_term_nodes(spark, sf_dir):
    """The graph without entities."""
    own, terms, _ = _graph_parts(spark, sf_dir)
    return knowledge.graph_nodes(own, terms, 100)


def graph_term_edges(spark, sf_dir):
    own, terms, _ = _graph_parts(spark, sf_dir)
    nodes = written(knowledge.graph_nodes(own, terms, 100), "nodes")
    edges = relations(spark, sf_dir).select("src_id", "dst_id", "rel_type").join(own.select(F.col("id").alias("src_id"), "doc_id"), "src_id")
    return knowledge.graph_edges(nodes, edges, terms)


def graph_stats(spark, sf_dir):
    own, terms, mentions = _graph_parts(spark, sf_dir)
    return knowledge.graph_stats(own, terms, 100, mentions)


def graph_preview_seed(spark, sf_dir):
    documents = first_rows(table(spark, sf_dir, "kb_documents"), "id", "created_at").select(F.col("id").alias("document_id"), "updated_at")
    own = chunks(spark, sf_dir, "kb_id", "document_id", "chunk_index", "created_at").join(documents, "document_id", "left")
    return knowledge.graph_seeds(relations(spark, sf_dir).select("kb_id", "id", "src_id", "dst_id", "weight"), 200, own)


QUERIES = {
    f.__name__: f
    for f in (
        figure_references, adjacent_media, sibling_pairs, inherited_relations, procedure_steps, causal_links, unique_relations, semantic_links,
        migrated_relations, entity_merge, entity_definitions, chunk_entities, graph_nodes, graph_edges, graph_term_nodes, graph_term_edges, graph_stats, graph_preview_seed,
    )
}

_TEXT = "(NOT coalesce(is_table_chunk, false) AND NOT coalesce(is_image_chunk, false) AND coalesce(layer, 'child') NOT IN ('parent', 'enhanced'))"
_N = links.NUMBER
_KEY = "regexp_replace(translate(regexp_extract(@, '" + _N + "'), '０１２３４５６７８９', '0123456789'), '[\\s\\-－–—]', '', 'g')"


def _refs(mark: str, flag: str) -> str:
    return f"""SELECT t.id AS a, f.id AS b, t.e AS evidence FROM (
    SELECT doc_id, id, {_KEY.replace('@', 'e')} AS key, arg_min(e, k) AS e FROM (
      SELECT doc_id, id, unnest(l) AS e, unnest(range(len(l))) AS k FROM (
        SELECT doc_id, id, regexp_extract_all(content, '(?:如\\s*)?{mark}\\s*{_N}') AS l FROM {_DOCS} WHERE {_TEXT})) GROUP BY ALL) t
  JOIN (SELECT doc_id, {_KEY.replace('@', 'l')} AS key, arg_min(id, idx) AS id FROM (
      SELECT doc_id, idx, id, unnest(regexp_extract_all(left(content, 300), '{mark}\\s*{_N}')) AS l FROM {_DOCS} WHERE {flag}) GROUP BY ALL) f
  ON t.doc_id = f.doc_id AND t.key = f.key"""


def _both(pairs: str, kind: str, back: str, more: str = "") -> str:
    return f"WITH pairs AS ({pairs}) SELECT a AS src_id, b AS dst_id, '{kind}' AS rel_type{more} FROM pairs UNION ALL SELECT b, a, '{back}'{more} FROM pairs"


_SIBLINGS = f"""SELECT m.id AS a, t.id AS b FROM {_DOCS} m JOIN {_DOCS} t ON m.doc_id = t.doc_id AND m.parent_id = t.parent_id
  WHERE m.layer = 'child' AND t.layer = 'child' AND m.parent_id <> '' AND (m.is_table_chunk OR m.is_image_chunk) AND NOT coalesce(t.is_table_chunk, false) AND NOT coalesce(t.is_image_chunk, false)"""
_HEAD = "lower(regexp_replace(left(content, 80), '^[\\s\\x{3000}\\x{00A0}]+|[\\s\\x{3000}\\x{00A0}]+$', '', 'g'))"
_STEP_NO = f"regexp_extract({_HEAD}, '{links.ORDER}', 1)"
_STEP = f"""CASE WHEN regexp_matches({_HEAD}, '{links.ORDER}') OR {' OR '.join(f"starts_with({_HEAD}, '{h}')" for h in links.HEADS)} THEN
  coalesce(nullif(CASE WHEN regexp_full_match({_STEP_NO}, '[0-9]{{1,9}}') THEN CAST({_STEP_NO} AS INT) WHEN length({_STEP_NO}) = 1 THEN instr('一二三四五六七八九十', {_STEP_NO}) END, 0), 999) END"""
_LABEL = "CASE WHEN length({0}) > 32 THEN left({0}, 31) || '…' ELSE {0} END"
_FLAT = "regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^[\\s\\x{{3000}}\\x{{00A0}}]+|[\\s\\x{{3000}}\\x{{00A0}}]+$', '', 'g')"
# Chunks in reading order, then the terms of the triples of the chunks shown, the surest triples first.
_NODES = f"""
WITH docs AS (SELECT * FROM {_DOCS}),
shown AS (SELECT doc_id, id FROM docs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx, id) <= 100),
lines AS (SELECT d.doc_id, s, o, row_number() OVER (PARTITION BY d.doc_id ORDER BY confidence DESC NULLS FIRST, s NULLS FIRST, p NULLS FIRST, o NULLS FIRST) AS line FROM {TRIPLES} t JOIN shown d ON t.source_chunk = d.id),
named AS (SELECT doc_id, term, min(pl) AS pl FROM (SELECT doc_id, s AS term, line * 2 AS pl FROM lines UNION ALL SELECT doc_id, o, line * 2 + 1 FROM lines) WHERE term <> '' GROUP BY ALL),
every AS (
  SELECT doc_id, id AS node_id, CASE WHEN is_table_chunk THEN 'table' WHEN is_image_chunk THEN 'image' ELSE 'text' END AS node_type,
    {_FLAT.format("coalesce(nullif(" + _FLAT.format("coalesce(title, '')") + ", ''), content, '')")} AS l, 0 AS rank, idx AS pl FROM docs
  UNION ALL SELECT doc_id, 'term:' || term, 'triple_term', {_FLAT.format('term')}, 1, pl FROM named),
nodes AS (SELECT doc_id, node_id, node_type, {_LABEL.format('l')} AS label FROM every QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, pl, node_id) <= 100)
"""

SQL = {
    "figure_references": f"""WITH pairs AS (SELECT a, b, min(evidence) AS e FROM ({_refs('图', 'is_image_chunk')} UNION ALL {_refs('表', 'is_table_chunk')}) GROUP BY a, b)
SELECT a AS src_id, b AS dst_id, 'refers_to' AS rel_type, 1.0::DOUBLE AS weight, left(e, 20) AS evidence FROM pairs
UNION ALL SELECT b, a, 'refers_to', 1.0::DOUBLE, left(e, 20) FROM pairs""",
    "adjacent_media": _both(
        f"SELECT id AS a, b FROM (SELECT *, last_value(CASE WHEN {_TEXT} THEN id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b FROM {_DOCS}) WHERE (is_table_chunk OR is_image_chunk) AND b IS NOT NULL",
        "adjacent",
        "adjacent",
    ),
    "sibling_pairs": _both(_SIBLINGS, "sibling", "sibling"),
    "inherited_relations": f"""WITH pairs AS ({_SIBLINGS}), rel AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)
SELECT e.id AS src_id, r.b AS dst_id, 'sibling' AS rel_type FROM {_DOCS} e JOIN rel r ON e.parent_id = r.a WHERE e.layer = 'enhanced'""",
    "procedure_steps": _both(
        f"""SELECT * FROM (SELECT id AS a, lead(id) OVER (PARTITION BY doc_id, parent_id ORDER BY step, idx) AS b FROM (
      SELECT *, {_STEP} AS step FROM {_DOCS} WHERE layer = 'child' AND parent_id IS NOT NULL) WHERE step IS NOT NULL) WHERE b IS NOT NULL""",
        "next_step",
        "prev_step",
    ),
    "causal_links": _both(
        f"""SELECT a, id AS b, regexp_extract(left(content, 200), '{"|".join(links.CAUSES)}') AS evidence FROM (
      SELECT *, lag(id) OVER w AS a, lag(parent_id) OVER w AS before FROM {_DOCS} WHERE layer = 'child' WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
    WHERE a IS NOT NULL AND (parent_id IS NULL OR before IS NULL OR parent_id = before) AND regexp_matches(left(content, 200), '{"|".join(links.CAUSES)}')""",
        "cause_of",
        "effect_of",
        ", 0.7::DOUBLE AS weight, evidence",
    ),
    "unique_relations": f"""SELECT src_id, dst_id, rel_type, round(weight::DOUBLE, 6) AS weight, id FROM {RELATIONS}
QUALIFY row_number() OVER (PARTITION BY src_id, dst_id, rel_type ORDER BY id) = 1""",
    "semantic_links": """
WITH best AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label IS DISTINCT FROM b.label WHERE a.vec_id % 20 = 0),
top AS (SELECT * FROM best WHERE sim >= 0.2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 10),
both_ways AS (SELECT a, b, max(sim) AS sim FROM (SELECT a, b, sim FROM top UNION ALL SELECT b, a, sim FROM top) GROUP BY a, b)
SELECT a AS src_id, b AS dst_id, CASE WHEN sim >= 0.35 THEN 'duplicate_of' ELSE 'semantic_similar' END AS rel_type, round(sim, 6) AS weight, 'cos=' || printf('%.3f', sim) AS evidence FROM both_ways""",
    "migrated_relations": f"""
SELECT a.src_id, a.dst_id, CASE WHEN a.parent_id = b.parent_id THEN 'sibling' ELSE 'adjacent' END AS rel_type FROM (
  SELECT DISTINCT id AS src_id, parent_id, unnest(CAST(json(CASE WHEN json_valid(related_ids) AND json_type(related_ids) = 'ARRAY' THEN related_ids END) AS VARCHAR[])) AS dst_id FROM {_DOCS}) a
JOIN {_DOCS} b ON a.dst_id = b.id WHERE a.dst_id <> a.src_id""",
    "chunk_entities": f"SELECT source_chunk AS chunk_id, list_sort(list(DISTINCT s) FILTER (WHERE s IS NOT NULL)) AS entities FROM {TRIPLES} WHERE source_chunk IS NOT NULL GROUP BY 1",
    "entity_definitions": f"""
WITH m AS (SELECT DISTINCT kb_id, s AS name, source_chunk FROM {TRIPLES}),
t AS (SELECT id, split_part(split_part({_FLAT.format('content')}, '。', 1), '；', 1) AS x FROM {CHUNKS} WHERE {_FLAT.format('content')} <> '')
SELECT kb_id, name, arg_min(CASE WHEN contains(x, name) THEN left(x, 120) ELSE name || '：' || left(x, 100) END, source_chunk) AS definition FROM m JOIN t ON t.id = m.source_chunk GROUP BY kb_id, name""",
    "graph_term_nodes": _NODES + "SELECT * FROM nodes",
    "graph_term_edges": _NODES
    + f""", hung AS (SELECT d.doc_id, d.id, 'term:' || s AS s, 'term:' || o AS o FROM {TRIPLES} t JOIN docs d ON t.source_chunk = d.id
    WHERE (d.doc_id, d.id) IN (SELECT (doc_id, node_id) FROM nodes) AND (d.doc_id, 'term:' || s) IN (SELECT (doc_id, node_id) FROM nodes) AND (d.doc_id, 'term:' || o) IN (SELECT (doc_id, node_id) FROM nodes))
SELECT DISTINCT d.doc_id, r.src_id AS src, r.dst_id AS dst, r.rel_type AS edge_type FROM {RELATIONS} r JOIN docs d ON d.id = r.src_id
  WHERE (d.doc_id, r.src_id) IN (SELECT (doc_id, node_id) FROM nodes) AND (d.doc_id, r.dst_id) IN (SELECT (doc_id, node_id) FROM nodes)
UNION SELECT doc_id, s, o, 'triple' FROM hung UNION SELECT doc_id, id, s, 'triple_source' FROM hung""",
    "graph_preview_seed": f"""
WITH top AS (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY weight DESC NULLS LAST, id) AS r FROM {RELATIONS} QUALIFY r <= 800),
ends AS (SELECT kb_id, src_id AS chunk_id, r * 2 AS pl FROM top UNION ALL SELECT kb_id, dst_id, r * 2 + 1 FROM top),
first AS (SELECT kb_id, chunk_id, min(pl) AS pl FROM ends WHERE chunk_id IS NOT NULL GROUP BY ALL),
recent AS (SELECT c.kb_id, c.id AS chunk_id, row_number() OVER (PARTITION BY c.kb_id ORDER BY d.updated_at DESC NULLS LAST, c.document_id NULLS LAST, c.chunk_index NULLS LAST, c.created_at NULLS LAST, c.id) AS pl
  FROM {CHUNKS} c LEFT JOIN (SELECT * FROM kb_documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1) d ON d.id = c.document_id WHERE c.kb_id IS NOT NULL),
every AS (SELECT kb_id, chunk_id, 0 AS late, pl FROM first UNION ALL SELECT kb_id, chunk_id, 1, pl FROM recent WHERE (kb_id, chunk_id) NOT IN (SELECT (kb_id, chunk_id) FROM first WHERE kb_id IS NOT NULL))
SELECT kb_id, chunk_id, row_number() OVER (PARTITION BY kb_id ORDER BY late, pl)::INT AS pos FROM every QUALIFY pos <= 200""",
}
