"""Projections and summaries on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from chunkweave.operators import merge, reports, retrieval
from chunkweave.sources import writers


def test_candidate_defaults(spark):
    df = spark.createDataFrame([("a", None, None, "s.pdf"), ("b", 3, 2, None)], "id string, page int, chunk_index int, source string")
    got = {r.id: (r.location, r.document_name, r.content, r.parent_id, r.score) for r in reports.candidate_view(df).collect()}
    assert got == {"a": ("P.0 · #1", "s.pdf", "", None, 0.0), "b": ("P.3 · #3", "", "", None, 0.0)}


def test_media_answers(spark):
    asked = spark.createDataFrame([("q", "图1"), ("r", "表2")], "query_id string, label string")
    hits = spark.createDataFrame([("q", 2, "x", "a", 1, 1), ("q", 1, "y", "b", 4, None)], "query_id string, rank int, id string, source string, page int, chunk_index int")
    got = {r.query_id: (r.answer, r.cannot_answer) for r in reports.media_answers(asked, hits).collect()}
    assert got == {"q": ("已定位到 图1，来源：b，位置：P.4。[1]", False), "r": ("根据现有文档无法回答该问题", True)}


def test_relation_arrays(spark):
    df = spark.createDataFrame([("a", [("b", "x"), ("c", "y")]), ("n", None)], "id string, r array<struct<dst_id:string,rel_type:string>>")
    got = [(r.id, r.k, r.h, r.t) for r in df.select("id", F.size(reports.of_types(F.col("r"), ["x"])).alias("k"), reports.has_relation(F.col("r"), F.lit("c")).alias("h"), reports.has_relation(F.col("r"), F.lit("c"), F.lit("x")).alias("t")).collect()]
    assert got == [("a", 1, True, False), ("n", 0, False, False)]


def test_page_counts_prefer_what_was_told(spark):
    blocks = spark.createDataFrame([("a", 0), ("a", 4), ("b", None), ("c", 2)], "doc_id string, page_idx int")
    told = spark.createDataFrame([("c", 9), ("a", 0)], "doc_id string, pages int")
    assert {r.doc_id: r.pages for r in reports.page_counts(blocks, told).collect()} == {"a": 5, "b": 0, "c": 9}


def test_export_keeps_formulas_from_running(spark):
    logs = spark.createDataFrame([(1, "=1+1", "2025-01-01"), (2, None, "2025-01-02"), (3, "ok", None)], "id bigint, s string, at string")
    assert [(r.id, r.s) for r in reports.log_export(logs, ["id", "s"], "at", "id", 2).collect()] == [("2", ""), ("1", "'=1+1")]


def test_final_check(spark):
    df = spark.createDataFrame([("q", "a", "Yes"), ("q", "b", "No."), ("r", "c", "no"), ("s", "d", None), ("s", "e", "no")], "query_id string, id string, answer string")
    assert sorted(r.id for r in retrieval.final_check(df).collect()) == ["a", "c", "d", "e"]


def test_hop_over_an_entity(spark):
    seeds = spark.createDataFrame([("q", "concept", "a")], "query_id string, intent string, id string")
    relations = spark.createDataFrame([("a", "e1", "mentions", 0.5), ("c", "d", "sibling", 1.0)], "src_id string, dst_id string, rel_type string, weight double")
    mentions = spark.createDataFrame([("e1", "a"), ("e1", "c"), ("e1", "c")], "entity_id string, chunk_id string")
    got = {r.id: (r.score, r.hop) for r in retrieval.expand_graph(seeds, relations, mentions=mentions).collect()}
    assert got == {"c": (0.45, 1), "d": (0.216, 2)}


def test_roll_back_and_watermark(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "c", 3), ("m", "x", 1)], "key string, value string, at int").withColumn("n", F.col("at"))
    log = merge.version_log(rows, "key", "value", "at", "n")
    targets = spark.createDataFrame([("k", 2), ("m", 9)], "key string, version int")
    assert {r.key: (r.value, r.version) for r in merge.rolled_back(log, targets, "key", "value").collect()} == {"k": ("b", 2), "m": ("x", 1)}
    assert merge.changes_since(rows, "at", 1).count() == 2 and merge.changes_since(rows, "at", None).count() == 4


def test_write_in_steps(spark):
    def fails():
        raise ValueError("no disk")

    done = writers.write_in_steps(spark, [("chunks", lambda: 3, True), ("links", fails, False), ("triples", lambda: 1, True)]).orderBy("step_no").collect()
    assert [(r.step, r.rows, r.failure) for r in done] == [("chunks", 3, None), ("links", None, "ValueError: no disk"), ("triples", 1, None)]
    with pytest.raises(ValueError):
        writers.write_in_steps(spark, [("chunks", fails, True)])
