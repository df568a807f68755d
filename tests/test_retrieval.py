import math

import pytest

from chunkweave.functions import text
from chunkweave.operators import evaluate, retrieval


def test_tokens_and_ratio(spark):
    row = spark.createDataFrame([("Für Pump_1 检A!",)], "t string").select(text.tokens("t").alias("k"), text.punctuation_ratio("t").alias("p")).first()
    assert row.k == ["f", "r", "pump_1", "检", "a"] and row.p == pytest.approx(2 / 14)


def test_bm25_formula(spark):
    docs = [("k", "1", "a a b"), ("k", "2", "b c"), ("k", "3", None), ("x", "4", "a")]
    corpus = spark.createDataFrame(docs, "group string, id string, text string")
    queries = spark.createDataFrame([("q", "k", "a a c"), ("r", "k", "zzz")], "query_id string, group string, text string")
    got = {r.id: r.score for r in retrieval.bm25(corpus, queries, 10).collect()}
    mean = 5 / 3
    idf = math.log((3 - 1 + 0.5) / (1 + 0.5) + 1)
    one = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / mean))
    two = idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / mean))
    assert got == {"1": 1.0, "2": pytest.approx(two / one, abs=1e-6)}


def test_fusion_keeps_the_first_score(spark):
    rows = [("q", "dense", 1, "a", 0.9), ("q", "dense", 2, "b", 0.8), ("q", "sparse", 1, "a", 0.7), ("q", "sparse", 2, "c", 0.6)]
    df = spark.createDataFrame(rows, "query_id string, channel string, rank int, id string, score double")
    got = {r.id: (r.score, r.sources) for r in retrieval.reciprocal_fusion(df, ["dense", "sparse"]).collect()}
    assert got["a"] == (round(0.9 + 2 / 61, 6), ["dense", "sparse"]) and got["c"][0] == round(0.6 + 1 / 62, 6)


CHUNKS = "id string, layer string, parent_id string, content string, related_ids string, document_id string, page int, is_image_chunk boolean, chunk_index int"


def chunks(spark, *rows):
    return spark.createDataFrame(rows, CHUNKS)


def hits(spark, *rows):
    return spark.createDataFrame(rows, "query_id string, id string, score double")


def test_fold(spark):
    own = chunks(spark, ("e1", "enhanced", "c1", "[图像描述] 图1-1", None, "d", 0, False, 0), ("e2", "enhanced", "zz", "x", None, "d", 0, False, 0), ("c1", "child", None, "t", None, "d", 0, False, 1))
    got = [tuple(r) for r in retrieval.fold_enhanced(hits(spark, ("q", "e1", 0.8), ("q", "c1", 0.1), ("q", "e2", 0.9)), own).collect()]
    assert got == [("q", "c1", 0.76, ["child", "enhanced"])]


def test_related(spark):
    own = chunks(
        spark, ("c1", "child", None, "", '["c2","i1","i2","c1"]', "d", 0, False, 0), ("c2", "child", None, "", None, "d", 0, False, 1),
        ("i1", "child", None, "", "[]", "d", 5, True, 2), ("i2", "child", None, "", "null", "d", 5, True, 3),
    )
    got = {r.id: r.score for r in retrieval.inherit_related(hits(spark, ("q", "c1", 0.8)), own).collect()}
    assert got == {"c2": pytest.approx(0.68), "i1": pytest.approx(0.36)}
    assert {r.id: r.score for r in retrieval.expand_related(hits(spark, ("q", "c1", 0.8)), own).collect()} == {"c1": 0.8, "c2": 0.3, "i1": 0.3, "i2": 0.3}


def test_parents_and_windows(spark):
    own = chunks(spark, *[(f"c{k}", "child", "p1", f"part {k}", None, "d", 0, False, k) for k in range(1, 6)], ("p1", "parent", None, "", None, "d", 0, False, 0))
    parents = retrieval.aggregate_parents(hits(spark, ("q", "c1", 0.4), ("q", "c2", 0.8), ("r", "c5", 0.5)), own)
    got = {r.query_id: (r.id, r.best_child, r.score) for r in parents.collect()}
    assert got == {"q": ("p1", "c2", 0.8), "r": ("p1", "c5", 0.5)}
    windows = {r.query_id: r.context for r in retrieval.context_windows(parents, own).collect()}
    assert windows == {"q": "part 1\n\npart 2\n\npart 3", "r": "part 3\n\npart 4\n\npart 5"}


def test_coarse_filter(spark):
    assert [r.id for r in retrieval.coarse_filter(hits(spark, ("q", "a", 0.2), ("q", "b", 0.4)), 0.3, 5).collect()] == ["b"]


def test_snapshot_score(spark):
    df = spark.createDataFrame([("a", 0.9, 1, 0.5, 2), ("b", None, None, 7.0, 1), ("c", None, None, None, 3), ("e", None, None, None, None)], "id string, dense_score double, dense_rank int, sparse_score double, sparse_rank int")
    got = {r.id: r.score for r in retrieval.snapshot_score(df).collect()}
    assert got == {"a": pytest.approx(0.9 + 1 / 61 + 1 / 62, abs=1e-6), "b": 1.0, "c": pytest.approx(1 / 63, abs=1e-6), "e": 0.0}


def test_entities(spark):
    queries = spark.createDataFrame([("q", "k", "什么是应急预案")], "query_id string, group string, text string")
    entities = spark.createDataFrame([("k", "应急预案", ["预案"]), ("k", "别的", []), ("k", "", None)], "group string, name string, aliases array<string>")
    mentions = spark.createDataFrame([("k", "应急预案", "c1"), ("k", "别的", "c2")], "group string, name string, chunk_id string")
    assert [tuple(r) for r in retrieval.entity_hits(queries, entities, mentions, 5).collect()] == [("q", "c1", 0.92)]


def test_media_reference(spark):
    queries = spark.createDataFrame([("q", "k", "请看图１－２"), ("r", "k", "nothing")], "query_id string, group string, text string")
    own = spark.createDataFrame([("k", "a", "图1-2 标题", "x", 3, 1), ("k", "b", None, "见图 1-2。", 0, 0), ("k", "c", "图9", "y", 0, 0)], "group string, id string, title string, content string, page int, chunk_index int")
    assert [(r.id, r.score) for r in retrieval.media_reference_hits(queries, own, 5).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.98)]


def test_graph_expansion(spark):
    seeds = spark.createDataFrame([("q", "procedure", "a")], "query_id string, intent string, id string")
    edges = spark.createDataFrame([("a", "b", "next_step", 0.5), ("b", "c", "sibling", 1.0), ("c", "d", "sibling", 1.0), ("b", "a", "next_step", 1.0), ("a", None, "x", 1.0), ("a", "c", "odd", None)], "src_id string, dst_id string, rel_type string, weight float")
    got = {r.id: (r.hop, r.score) for r in retrieval.expand_graph(seeds, edges).collect()}
    assert got == {"b": (1, 0.5), "c": (1, 0.0), "d": (2, 0.0)}


def test_citations_and_scores(spark):
    contexts = spark.createDataFrame([("x", 1, "c1", None, 0.8), ("x", 2, "c2", 0.7, 0.6)], "answer_id string, idx int, chunk_id string, rerank_score double, dense_score double")
    answers = spark.createDataFrame([("x", "证据[2] 和 [9] 再[1][2]")], "answer_id string, answer string")
    cited = retrieval.citations(answers, contexts)
    assert [(r.no, r.chunk_id, r["first"]) for r in cited.orderBy("first").collect()] == [(2, "c2", 1), (1, "c1", 2)]
    more = spark.createDataFrame([("x", 1, "c1"), ("x", 9, "c9")], "answer_id string, no int, chunk_id string")
    assert retrieval.rule_scores(contexts, more).first()[1:] == (0.75, 0.5)


def test_intents(spark):
    df = spark.createDataFrame([("如何操作",), ("什么是泵",), ("多少",), ("看图",), ("hello",), (None,)], "q string")
    assert [r[0] for r in df.select(retrieval.intent("q")).collect()] == ["procedure", "concept", "data", "visual", "general", "general"]


def test_answers_and_prompts(spark):
    queries = spark.createDataFrame([("q", "阀门 检查")], "query_id string, text string")
    contexts = spark.createDataFrame([("q", 1, 0.9, "阀门很好。阀门要检查。其他", "s", 0), ("q", 2, 0.1, "弱。", None, None)], "query_id string, idx int, score double, content string, source string, page int")
    assert [tuple(r) for r in retrieval.extracted_answers(queries, contexts).collect()] == [("q", 1, "阀门要检查。")]
    assert retrieval.prompts(queries, contexts).first().prompt.startswith("[1] s P.1\n阀门很好")


def test_metrics(spark):
    found = spark.createDataFrame([("s", "q", k + 1, c) for k, c in enumerate("abc")] + [("s", "n", 1, "a")], "strategy string, query_id string, rank int, id string")
    truth = spark.createDataFrame([("q", ["b", "d"]), ("n", None)], "query_id string, ids array<string>")
    got = {r.query_id: r for r in evaluate.retrieval_metrics(found, truth, 2).collect()}
    assert (got["q"].recall, got["q"].mrr) == (0.5, 0.5) and got["q"].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert tuple(got["n"])[2:] == (0.0, 0.0, 0.0)
    assert evaluate.mean_metrics(evaluate.retrieval_metrics(found, truth, 2)).first().queries == 2


def test_dense(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id int, v array<double>")
    assert [r.id for r in retrieval.dense_topk(df, [1.0, 0.0], 2, "id", "v").collect()] == [1, 2]
