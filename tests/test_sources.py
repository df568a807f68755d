import io
import json
import zipfile

import pytest

from chunkweave.sources import readers, writers


def test_content_list(spark):
    entries = [
        {"type": "header", "text": "T", "text_level": 1, "page_idx": 0},
        {"type": "page_number", "text": "3", "page_idx": 0},
        {"type": "table", "table_body": "<table/>", "page_idx": 1, "bbox": [0, 0, 1, 1]},
        {"type": "odd", "text": "x", "bbox": [1, 2]},
    ]
    df = spark.createDataFrame([("d", json.dumps(entries)), ("e", None), ("f", "broken")], "doc string, payload string")
    got = [(r.type, r.text, r.page_idx, r.table_html, r.bbox) for r in readers.content_list_blocks(df, "doc", "payload").orderBy("block_pos").collect()]
    assert got == [("title", "T", 0, None, None), ("table", "", 1, "<table/>", [0.0, 0.0, 1.0, 1.0]), ("text", "x", 0, None, None)]


def test_markdown(spark):
    text = "# Head\r\nline\n| a | b |\n| 1 | 2 |\n\n| c |\n![alt](img/p.png)\n## Sub ##"
    df = spark.createDataFrame([("d", text), ("e", None)], "doc string, text string")
    blocks = readers.markdown_blocks(df, "doc", "text")
    got = [(r.type, r.text, r.text_level, r.image_path) for r in blocks.orderBy("block_pos").collect()]
    assert got == [("title", "Head", 1, None), ("text", "line", None, None), ("table", "| a | b |\n| 1 | 2 |", None, None), ("table", "| c |", None, None), ("image", "alt", None, "img/p.png"), ("title", "Sub ##", 2, None)]
    twice = blocks.unionByName(blocks.selectExpr("doc_id", "type", "text", "text_level", "image_path", "block_pos + 100 AS block_pos")).selectExpr("*", "0 AS page_idx")
    assert readers.distinct_blocks(twice).count() == 6


def test_nested_records(spark):
    data = {"pages": [{"pageNo": 2, "layouts": [{"type": "Heading", "text": " T "}, {"text": "x"}, {"text": "x"}, {"text": " "}]}, {"page_idx": 4, "blocks": {"category": "table", "html": "<t/>"}}, {"imageUrl": "a.png"}]}
    deep = {"text": "bottom"}
    for _ in range(3000):
        deep = {"blocks": [deep]}
    df = spark.createDataFrame([("d", json.dumps(data)), ("e", "{broken"), ("f", None)], "doc string, payload string")
    got = [(r.type, r.text, r.page_idx, r.table_html, r.image_path) for r in readers.nested_record_blocks(df, "doc", "payload").orderBy("block_pos").collect()]
    assert got == [("title", "T", 1, None, None), ("text", "x", 1, None, None), ("table", "<t/>", 4, "<t/>", None), ("image", "", 0, None, "a.png")]
    assert [leaf[1] for leaf in readers.walk_records(deep)] == ["bottom"]


def test_pages(spark):
    df = spark.createDataFrame([("3",), ("0",), (None,), ("[7, 8]",), ("x",)], "p string")
    assert [r[0] for r in df.select(readers.page_index("p")).collect()] == [2, 0, 0, 6, 0]


def test_web(spark):
    title, text, links = readers.web_page("<title>A  b</title><script>no</script><h1>One</h1><p>two &amp; <b>three</b></p><a href='/x'>go</a><a href='/x'>on</a>")
    assert (title, text, links) == ("A b", "One\ntwo & three\ngoon", ["/x"])
    assert readers.web_page(None) == ("", "", [])
    urls = ["https://example.com/a", "http://localhost/x", "http://10.1.2.3", "ftp://example.com", "http://192.168.0.1/", "https://user@example.org:8443/", "http://[::1]/", None, "http://172.20.1.1"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(readers.is_public_url("u")).collect()]
    assert got == [True, False, False, False, False, True, False, None, False]


def test_crawl(spark):
    base = "https://example.com"
    pages = spark.createDataFrame(
        [(f"{base}/", [f"{base}/a#x", "https://other.com/", f"{base}/private/z"]), (f"{base}/a", [f"{base}/b", f"{base}/"]), (f"{base}/b", [f"{base}/c"]), (f"{base}/c", []), (f"{base}/private/z", [])],
        "url string, links array<string>",
    )
    seeds = spark.createDataFrame([(f"{base}/#top",)], "url string")
    got = {r.url.removeprefix(base): r.level for r in readers.crawl(pages, seeds, 2, exclude=["private"]).collect()}
    assert got == {"/": 0, "/a": 1, "/b": 2}


def test_office(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>Three</w:t></w:p>")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, bool(r.failure)) for r in readers.read(spark, "office", str(tmp_path)).collect()}
    assert got == {"a.docx": ("One & two\nThree", False), "b.docx": (None, True)}
    with pytest.raises(ValueError):
        readers.read(spark, "unknown")


def test_eval_and_backup(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"id": "q1", "query": "x", "ground_truth_chunks": ["a"]}\n\n{"id": "q2"}\n')
    assert [r.id for r in readers.read(spark, "jsonl_eval", str(tmp_path / "e.jsonl")).orderBy("id").collect()] == ["q1", "q2"]
    chunks = spark.createDataFrame([("a", 'say "hi",\nnow', 3, '["b"]'), ("b", "plain", None, None)], "id string, content string, page int, related_ids string")
    vectors = spark.createDataFrame([("a", [0.5, 1.5]), ("b", [0.0, 2.0])], "id string, embedding array<float>")
    writers.write_csv(writers.backup_rows(chunks, vectors, 2), str(tmp_path / "backup"))
    back = {r.id: r for r in readers.read(spark, "backup_csv", str(tmp_path / "backup"), size=2).collect()}
    assert back["a"].content == 'say "hi",\nnow' and back["a"].page == 3 and back["a"].related_ids == ["b"] and back["a"].embedding == [0.5, 1.5]
    assert back["b"].page == 0 and back["b"].related_ids == []
    with pytest.raises(Exception, match="vector of the right size"):
        writers.backup_rows(chunks, vectors.filter("id = 'a'"), 2).collect()


def test_export_and_append(spark, tmp_path):
    documents = spark.createDataFrame([("d", "f.pdf")], "id string, filename string")
    chunks = spark.createDataFrame([("c", "d", 0, 3, "child", None, "x", " id9 ")], "id string, document_id string, chunk_index int, page int, layer string, title string, content string, related_ids string")
    relations = spark.createDataFrame([("c",), ("c",)], "src_id string")
    triples = spark.createDataFrame([], "source_chunk string")
    row = writers.document_export(documents, chunks, relations, triples).first()
    assert (row.page, row.title, row.related_ids, row.relations, row.triples) == (4, "", '["id9"]', 2, 0)
    path = str(tmp_path / "table")
    writers.append_new(chunks, path, ["id"])
    writers.append_new(chunks.unionByName(chunks.selectExpr("'n' AS id", *[c for c in chunks.columns if c != "id"])), path, ["id"])
    assert spark.read.parquet(path).count() == 2


def test_settings(spark):
    wanted = spark.createDataFrame([("a", "0"), ("b", "0"), ("c", "0")], "key string, default string")
    one = spark.createDataFrame([("a", "1")], "key string, value string")
    two = spark.createDataFrame([("a", "2"), ("b", "2")], "key string, value string")
    assert sorted(map(tuple, readers.resolve_settings(wanted, one, two).collect())) == [("a", "1", "layer1"), ("b", "2", "layer2"), ("c", "0", "default")]


def test_provider_blocks_take_markdown_first(spark):
    data = {"blocks": [{"type": "title", "text": "Head"}, {"text": "line"}, {"text": "only here", "page_idx": 3}]}
    df = spark.createDataFrame([("d", "# Head\nline", json.dumps(data)), ("e", None, None)], "doc string, md string, payload string")
    got = [(r.block_pos, r.type, r.text, r.page_idx) for r in readers.provider_blocks(df, "doc", "md", "payload").orderBy("block_pos").collect()]
    assert got == [(0, "title", "Head", 0), (1, "text", "line", 0), (2, "text", "only here", 3)]


def test_images_and_missing_files(spark, tmp_path):
    for name in ("a.PNG", "b.txt", "c.jpeg"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.doc_id for r in readers.read(spark, "images", str(tmp_path)).collect()) == ["a.PNG", "c.jpeg"]
    assert readers.read_eval(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_crawl_is_bounded(spark):
    pages = spark.createDataFrame([(f"https://x.example/{k}", [f"https://x.example/{k + 1}", f"https://x.example/{2 * k}"]) for k in range(80)], "url string, links array<string>")
    seeds = spark.createDataFrame([("https://x.example/1",)], "url string")
    assert readers.crawl(pages, seeds, 6, most=20).count() == 20
    assert readers.crawl(pages, seeds, 1, most=2).count() == 2
