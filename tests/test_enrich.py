from chunkweave.operators import enrich


def test_model_calls(spark):
    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    enrich.register_model("upper", model)
    df = spark.createDataFrame([(1, "a"), (2, None), (3, " "), (4, "b")], "id int, text string").coalesce(1)
    got = {r.id: (r.answer, r.failure) for r in enrich.call_model(df, "text", model).collect()}
    assert got == {1: ("A", None), 2: (None, None), 3: (None, None), 4: ("B", None)}
    bad = spark.createDataFrame([(1, "bad")], "id int, text string")
    assert enrich.call_model(bad, "text", model).first().failure == "RuntimeError: no"


def test_enhanced_answers(spark):
    rows = [
        ("plain", '{"summary": "s", "entities": [{"name": "E", "type": "Concept"}, {"type": "x"}], "triples": [{"s": "a", "p": "b", "o": "c"}, {"s": "a", "p": "", "o": "c"}]}'),
        ("fenced", '```json\n{"summary": "f", "triples": [{"s": "a", "p": "b", "o": "c", "confidence": 3},],}\n```'),
        ("text", "only words " * 40),
        ("none", None),
    ]
    df = spark.createDataFrame(rows, "id string, answer string").select("id", enrich.parse_enhanced("answer").alias("e"))
    got = {r.id: r.e for r in df.collect()}
    assert got["plain"].summary == "s" and [e.name for e in got["plain"].entities] == ["E"]
    assert [(t.s, t.confidence) for t in got["plain"].triples] == [("a", 0.7)]
    assert got["fenced"].summary == "f" and got["fenced"].triples[0].confidence == 1.0
    assert len(got["text"].summary) == 200 and got["text"].entities == [] and got["none"].summary == ""
    chunks = spark.createDataFrame([("k", "e", "c", "enhanced", [("a", "b", "c", 0.5)]), ("k", "x", None, "child", [("q", "b", "c", 0.5)])], f"kb_id string, id string, parent_id string, layer string, triples array<{enrich.TRIPLE}>")
    assert [(r.s, r.source_chunk) for r in enrich.triples_of(chunks).collect()] == [("a", "c")]


def test_scores():
    assert enrich.parse_scores('[1, 9, "keep"]', 3) == [1, 5, 5]
    assert enrich.parse_scores('```json\n{"scores": [{"index": 1, "score": 2},]}\n```', 3) == [3, 2, 3]
    assert enrich.parse_scores('{"0": 4, "2": {"decision": "discard"}}', 3) == [4, 3, 1]
    assert enrich.parse_scores("score 4/5\nplease discard\nhm", 4) == [4, 1, 3, 3]
    assert enrich.parse_scores(None, 2) == [3, 3]


def test_cleaning_actions(spark):
    blocks = spark.createDataFrame([("d", 0, "old", False), ("d", 1, "junk", False), ("d", 2, "tab", True), ("d", 3, "same", None)], "doc_id string, block_pos int, text string, is_table boolean")
    actions = spark.createDataFrame([("d", 0, "fix", "new"), ("d", 1, "discard", None), ("d", 2, "discard", None), ("d", 3, "fix", " ")], "doc_id string, block_pos int, action string, text string")
    assert {r.block_pos: r.text for r in enrich.apply_cleaning(blocks, actions).collect()} == {0: "new", 2: "tab", 3: "same"}


def test_rerank_and_channels(spark):
    hits = spark.createDataFrame([("q", "a", 0.9, 0.9), ("q", "b", 0.5, None), ("q", "c", 0.2, 0.0)], "query_id string, id string, score double, dense_score double")
    scores = spark.createDataFrame([("q", "b", 0.95)], "query_id string, id string, rerank_score double")
    assert [r.id for r in enrich.rerank(hits, scores, 2).orderBy("rank").collect()] == ["b", "a"]
    row = enrich.recall_channels(hits).first()
    assert (row.total, row.dense, row.other, row.related) == (3, 1, 2, 1)


def test_shards_and_routes(spark):
    blocks = spark.createDataFrame([("d", 0, 0, 0, "a"), ("d", 1, 0, 0, "b"), ("d", 0, 1, 2, "c")], "doc_id string, shard_no int, block_pos int, page_idx int, text string")
    shards = spark.createDataFrame([("d", 0, 0), ("d", 1, 3)], "doc_id string, shard_no int, start_page int")
    got = [(r.text, r.page_idx) for r in enrich.merge_shards(blocks, shards).orderBy("block_pos").collect()]
    assert got == [("a", 0), ("c", 2), ("b", 3)]
    pages = spark.createDataFrame([("d", 500, 0, 0, False), ("d", 10, 0, 0, False), ("d", 500, 9, 0, False), ("d", 500, 0, 0, True)], "doc_id string, text_chars int, image_count int, drawing_count int, likely_scanned boolean")
    row = enrich.route_summary(enrich.page_routes(pages)).first()
    assert (row.local_pages, row.cloud_pages, row.uncertain_pages, row.local_share, row.advice) == (1, 2, 1, 0.25, "trial")


def test_kinds(spark):
    df = spark.createDataFrame([("x" * 100, False, False), ("short", False, False), ("如上所述" + "x" * 100, False, False), ("x", True, False), ("x", False, True)], "content string, is_table_chunk boolean, is_image_chunk boolean")
    assert [r[0] for r in df.select(enrich.enhancement_kind(df)).collect()] == ["text", "fragment", "fragment", "table", "image"]
