import pytest

from chunkweave.operators import knowledge, links

SCHEMA = "doc_id string, idx int, id string, content string, layer string, parent_id string, is_table_chunk boolean, is_image_chunk boolean, related_ids string"


def chunks(spark, *rows):
    return spark.createDataFrame([("d", k, *r[:4], r[4] == "t", r[4] == "i", r[5] if len(r) > 5 else None) for k, r in enumerate(rows)], SCHEMA)


def pairs(df):
    return sorted((r.src_id, r.dst_id, r.rel_type) for r in df.collect())


def test_references(spark):
    df = chunks(
        spark,
        ("a", "正确性(如图1-3-3-6)。又见 图 １－３－３－６ 和表9。", "child", None, ""),
        ("b", "图1-3-3-6 血液检查", "child", None, "i"),
        ("c", "图1336 重复", "child", None, "i"),
        ("e", None, "child", None, ""),
    )
    out = links.media_references(df)
    assert pairs(out) == [("a", "b", "refers_to"), ("b", "a", "refers_to")]
    assert out.first().evidence == "如图1-3-3-6"


def test_adjacent_looks_back_four(spark):
    text = [("a", "文", "child", None, "")]
    media = [(f"i{k}", "插图", "child", None, "i") for k in range(5)]
    got = pairs(links.adjacent_media(chunks(spark, *text, *media)))
    assert {p[1] for p in got if p[0] == "a"} == {"i0", "i1", "i2", "i3"}
    done = spark.createDataFrame([("i0",)], "id string")
    assert ("a", "i0", "adjacent") not in pairs(links.adjacent_media(chunks(spark, *text, *media), related=done))


def test_siblings_and_inheritance(spark):
    df = chunks(spark, ("t", "文", "child", "p", ""), ("m", "表", "child", "p", "t"), ("o", "表", "child", "q", "t"), ("g", "增强", "enhanced", "t", ""))
    own = links.siblings(df)
    assert pairs(own) == [("m", "t", "sibling"), ("t", "m", "sibling")]
    assert pairs(links.inherited(df, own)) == [("g", "m", "sibling")]


def test_procedures(spark):
    df = chunks(spark, ("s3", "第三步 完成", "child", "p", ""), ("s1", "第一步 准备", "child", "p", ""), ("s2", "第二步 执行", "child", "p", ""), ("x", "别的", "child", "p", ""), ("h", "首先 开始", "child", "p", ""))
    got = [p for p in pairs(links.procedure_links(df)) if p[2] == "next_step"]
    assert got == [("s1", "s2", "next_step"), ("s2", "s3", "next_step"), ("s3", "h", "next_step")]


def test_causes(spark):
    df = chunks(spark, ("a", "前置条件", "child", None, ""), ("b", "因为温度变化导致压力上升", "child", None, ""), ("c", "所以停机", "child", "p", ""), ("d", "因此", "child", "q", ""))
    got = pairs(links.causal_links(df))
    assert ("a", "b", "cause_of") in got and ("b", "a", "effect_of") in got and ("b", "c", "cause_of") in got and not any("d" in p[:2] for p in got)


def test_unique_relations(spark):
    rows = [("a", "b", "t", 1.0000000001, 2), ("a", "b", "t", 0.5, 1), ("a", "b", "u", -1e-12, 3)]
    got = {r.rel_type: (r.weight, r.n) for r in links.unique_relations(spark.createDataFrame(rows, "src_id string, dst_id string, rel_type string, weight double, n int"), "n").collect()}
    assert got == {"t": (0.5, 1), "u": (0.0, 3)}


def test_similar_pairs(spark):
    rows = [("a", "p1", [1.0, 0.0]), ("b", "p1", [0.99, 0.01]), ("c", "p2", [0.0, 1.0]), ("d", None, [2.0, 0.0]), ("z", None, None)]
    df = spark.createDataFrame(rows, "id string, parent_id string, v array<double>")
    got = {(r.a, r.b) for r in links.similar_pairs(df, "id", "v", "parent_id", 0.8, 10, block=2).collect()}
    assert got == {("a", "d"), ("d", "a"), ("b", "d"), ("d", "b")}
    kinds = {(r.src_id, r.dst_id): (r.rel_type, r.evidence) for r in links.semantic_links(links.similar_pairs(df, "id", "v", "parent_id", 0.8), 0.98).collect()}
    assert kinds["a", "d"] == ("duplicate_of", "cos=1.000")


def test_migration(spark):
    df = chunks(spark, ("a", "", "child", "p1", "", '["b","c","zz"]'), ("b", "", "child", "p1", "", "[]"), ("c", "", "child", "p2", "", "null"))
    assert pairs(links.migrated_relations(df)) == [("a", "b", "sibling"), ("a", "c", "adjacent")]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ([("AI", "Concept", ["人工智能"]), ("人工智能", "Concept", ["ML"])], [("人工智能", "Concept", ["AI", "ML"], 2)]),
        ([("OHSAS", "Standard", ["GB/T 28001"]), ("GB/T 28001", "Standard", [])], [("GB/T 28001", "Standard", ["OHSAS"], 2)]),
        ([("x", "Nonsense", []), ("X ", "Unknown", [])], [("x", "Unknown", [], 2)]),
        ([("a", "Concept", []), ("a", "Hazard", []), (" ", "Concept", [])], [("a", "Concept", [], 1), ("a", "Hazard", [], 1)]),
    ],
)
def test_entities(spark, raw, expected):
    df = spark.createDataFrame([("kb", k, n, t, a, f"c{k}") for k, (n, t, a) in enumerate(raw)], "kb_id string, seq int, name string, type string, aliases array<string>, source_chunk string")
    got = sorted((r.name, r.type, r.aliases, len(r.source_chunks)) for r in knowledge.merge_entities(df).collect())
    assert got == expected


def test_graph(spark):
    own = spark.createDataFrame([("d", "c1", 0, "", "text one", False, False), ("d", "c2", 1, "T", "x", True, False)], "doc_id string, id string, idx int, title string, content string, is_table_chunk boolean, is_image_chunk boolean")
    terms = spark.createDataFrame([("d", "s", "o")], "doc_id string, s string, o string")
    nodes = knowledge.graph_nodes(own, terms, 10)
    assert {r.node_id for r in nodes.collect()} == {"c1", "c2", "term:s", "term:o"}
    edges = spark.createDataFrame([("d", "c1", "c2", "refers_to"), ("d", "c1", "gone", "x")], "doc_id string, src_id string, dst_id string, rel_type string")
    assert {r.edge_type for r in knowledge.graph_edges(nodes, edges, terms).collect()} == {"refers_to", "triple"}
    assert knowledge.graph_nodes(own, terms, 1).count() == 1


def test_definitions(spark):
    mentions = spark.createDataFrame([("k", "泵", "c1"), ("k", "阀", "c1"), ("k", "无", "c9")], "kb_id string, name string, source_chunk string")
    texts = spark.createDataFrame([("c1", "泵是设备；其他。后")], "id string, content string")
    assert {r.name: r.definition for r in knowledge.define_entities(mentions, texts).collect()} == {"泵": "泵是设备", "阀": "阀：泵是设备"}
