"""Queries leave out no rows of their tables: checked against SQL and figures that are independent of the plans."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from chunkweave.operators import evaluate, knowledge

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
QUERIES = entry.queries()
CHUNKS = f"(SELECT * FROM '{DATA}/tmp_chunks_upload.parquet' WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"


def rows(sql):
    duckdb = pytest.importorskip("duckdb")
    return Counter(duckdb.connect().sql(sql).fetchall())


def test_drafts_of_every_page_are_merged(spark):
    got = Counter((r.document_id, r.page, r.drafts) for r in QUERIES["draft_merge"](spark, DATA).collect())
    assert got == rows(f"SELECT document_id, page, count(*)::INT FROM {CHUNKS} WHERE document_id IS NOT NULL GROUP BY ALL")
    assert any(page is None for _, page, _ in got) and any((page or 0) >= 3 for _, page, _ in got)


@pytest.mark.parametrize("name", ["chunk_fixed_length", "chunk_separator"])
def test_tables_and_images_are_whole_chunks(spark, name):
    media = f"""SELECT coalesce(document_id, ''), chunk_index, 0, coalesce(page, -1), CASE WHEN content <> '' THEN content
      WHEN is_image_chunk AND NOT coalesce(is_table_chunk, false) THEN '[图片 第' || (coalesce(page, 0) + 1) || '页]' ELSE '' END
      FROM {CHUNKS} WHERE layer <> 'enhanced' AND (is_table_chunk OR is_image_chunk)"""
    want = rows(media)
    got = Counter(tuple(r[c] for c in ("doc_id", "block_pos", "part_no", "page_idx", "content")) for r in QUERIES[name](spark, DATA).collect())
    assert want and not want - got


def test_items_without_a_hit_count_as_zero(spark):
    found = spark.createDataFrame([("a", "q1", 1, "x"), ("b", "q2", 1, "y")], "strategy string, query_id string, rank int, id string")
    truth = spark.createDataFrame([("q1", ["x"]), ("q2", ["z"]), ("q3", ["x"]), ("q4", None)], "query_id string, ids array<string>")
    metrics = evaluate.retrieval_metrics(found, truth)
    assert metrics.count() == 8 and metrics.filter("recall = 1 AND mrr = 1 AND ndcg = 1").count() == metrics.filter("recall > 0").count() == 1
    means = {r.strategy: (r.queries, r.recall) for r in evaluate.mean_metrics(metrics).collect()}
    assert means == {"a": (4, 0.25), "b": (4, 0.0)}
    named = evaluate.retrieval_metrics(found, truth, strategies=["a", "b", "c"])
    assert named.filter("strategy = 'c' AND recall = 0 AND mrr = 0 AND ndcg = 0").count() == 4


def test_every_item_is_in_the_means(spark):
    items = rows(f"SELECT count(DISTINCT id) FROM '{DATA}/eval_records.parquet'")
    means = QUERIES["eval_means"](spark, DATA).collect()
    assert {r.strategy for r in means} == {"content", "title"} and all(items[(r.queries,)] for r in means)


def test_graph_shows_entities_and_sources(spark):
    own = spark.createDataFrame([("d", f"c{k}", k, "", "text", False, False) for k in range(3)], "doc_id string, id string, idx int, title string, content string, is_table_chunk boolean, is_image_chunk boolean")
    terms = spark.createDataFrame([("d", "c0", "b", "r", "a", 0.5), ("d", "c2", "x", "r", "y", 0.9)], "doc_id string, chunk_id string, s string, p string, o string, confidence double")
    mentions = spark.createDataFrame([("d", "c1", "7", "Pump"), ("d", "c2", "7", "Pump")], "doc_id string, chunk_id string, entity_id string, name string")
    edges = spark.createDataFrame([("d", "c0", "c1", "next")], "doc_id string, src_id string, dst_id string, rel_type string")
    nodes = knowledge.graph_nodes(own, terms, 6, mentions)
    assert {r.node_id for r in nodes.collect()} == {"c0", "c1", "c2", "entity:7", "term:x", "term:y"}  # the surest triple first
    got = {tuple(r) for r in knowledge.graph_edges(nodes, edges, terms, mentions).drop("doc_id").collect()}
    assert got == {("c0", "c1", "next"), ("term:x", "term:y", "triple"), ("c2", "term:x", "triple_source"), ("c1", "entity:7", "mentions"), ("c2", "entity:7", "mentions")}
    assert tuple(knowledge.graph_stats(own, terms, 6, mentions).first()) == ("d", 6, 3, 3, 2, True)
    assert tuple(knowledge.graph_stats(own, terms, 8, mentions).first()) == ("d", 8, 3, 5, 0, False)
    assert {r.node_id for r in knowledge.graph_nodes(own, terms, 1, mentions).collect()} == {"c0"}


def test_preview_is_topped_up_with_recent_chunks(spark):
    relations = spark.createDataFrame([("k", "1", "b", "a", 1.0)], "kb_id string, id string, src_id string, dst_id string, weight double")
    chunks = [("k", c, d, n, 0, at) for c, d, n, at in (("a", "d1", 0, 5), ("c", "d1", 1, 5), ("d", "d2", 0, 9), ("e", None, 0, None))] + [("other", "z", "d3", 0, 0, 1)]
    chunks = spark.createDataFrame(chunks, "kb_id string, id string, document_id string, chunk_index int, created_at int, updated_at int")
    seeds = knowledge.graph_seeds(relations, 4, chunks).orderBy("kb_id", "pos").collect()
    assert [tuple(r) for r in seeds] == [("k", "b", 1), ("k", "a", 2), ("k", "d", 3), ("k", "c", 4), ("other", "z", 1)]


def test_graphs_show_every_chunk(spark):
    shown = {r.node_id for r in QUERIES["graph_nodes"](spark, DATA).filter("node_type IN ('text', 'table', 'image')").collect()}
    assert shown == {i for (i,) in rows(f"SELECT id FROM {CHUNKS} WHERE document_id IS NOT NULL AND chunk_index IS NOT NULL")}
