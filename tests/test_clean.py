from chunkweave.operators import clean

SCHEMA = "doc_id string, block_pos int, type string, text string, page_idx int, is_table boolean, image_path string, removed int"


def blocks(spark):
    rows = [
        ("d", 0, "text", "A proper sentence of text.", 0, False, None, 0),
        ("d", 1, "text", " . ", 0, False, None, 0),
        ("d", 2, "text", "short", 0, False, None, 0),
        ("d", 3, "title", "One", 0, False, None, 0),
        ("d", 4, "text", "!!!???...---===+++", 0, False, None, 0),
        ("d", 5, "text", "Copyright © 2024 Example Ltd.", 0, False, None, 0),
        ("d", 6, "text", "https://example.com " + "x" * 300, 0, False, None, 0),
        ("d", 7, "table", "", 0, True, None, 0),
        ("d", 8, "image", "", 1, False, "a.png", 0),
        ("d", 9, "image", "", 1, False, "a.png", 0),
        ("d", 10, "image", "", 2, False, "a.png", 0),
        ("d", 11, "text", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_rules(spark):
    cleaned = clean.clean_blocks(blocks(spark))
    got = {r.block_pos: r.removed_by for r in cleaned.collect()}
    assert got == {
        0: None, 1: "remove_empty", 2: "remove_short", 3: None, 4: "remove_punctuation", 5: "remove_copyright", 6: None, 7: None, 8: None, 9: "remove_duplicate_images", 10: None, 11: "remove_empty",
    }
    assert {r.removed_by: r.removed for r in clean.removed_by_rule(cleaned).collect()}["remove_empty"] == 2
    previews = {r.block_pos: r.preview for r in clean.removed_previews(cleaned).collect()}
    assert previews[9] == "a.png" and previews[2] == "short"
    runtime = clean.clean_blocks(blocks(spark), clean.RUNTIME_RULES, min_chars=2)
    assert {r.block_pos for r in runtime.filter("removed_by IS NULL").collect()} == {0, 2, 3, 6, 7, 8, 9, 10}
    assert clean.clean_blocks(blocks(spark).limit(0)).count() == 0


def test_quality_gate(spark):
    rows = [("a", "words only", False, False, 5), ("b", "!!!!!!!!!!a", False, False, 5), ("c", "!!!!", True, False, 1), ("d", "words", None, None, 1), ("e", None, None, None, None), ("f", "", False, False, 9)]
    chunks = spark.createDataFrame(rows, "id string, content string, is_table_chunk boolean, is_image_chunk boolean, score int")
    assert {r.id for r in clean.quality_gate(chunks, "content").filter("passed").collect()} == {"a", "c", "d", "e", "f"}
    scored = clean.quality_gate(chunks, "content", score=chunks["score"])
    assert {r.id for r in scored.filter("passed").collect()} == {"a", "c", "e", "f"}
    row = clean.gate_breakdown(scored).first()
    assert (row.total, row.passed, row.discarded) == (6, 4, 2)
