"""Readers: parser output, markdown, web pages, office files, backups and evaluation sets as DataFrames."""

from __future__ import annotations

import html
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from io import BytesIO
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkweave.runtime import written

_READERS: dict[str, Callable[..., DataFrame]] = {}

# Block types of parser categories.
CATEGORIES = {"text": "text", "header": "title", "title": "title", "table": "table", "image": "image", "interline_equation": "text"}
BLOCK_TAGS = frozenset("p div br li ul ol tr table section article header footer h1 h2 h3 h4 h5 h6 blockquote pre".split())
HIDDEN_TAGS = frozenset(("script", "style", "noscript", "svg"))

CONTENT_LIST = "array<struct<type:string,text:string,text_level:int,page_idx:int,table_body:string,img_path:string,bbox:array<double>>>"
EVAL_SCHEMA = "id string, kb_id string, query string, intent string, ground_truth_chunks array<string>, ground_truth_answer string, cross_section boolean, tags array<string>, notes string"


def register_reader(name: str):
    def add(reader):
        _READERS[name] = reader
        return reader

    return add


def read(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    """Read with a registered reader; an unknown name is an error, never a silent fallback."""
    if name not in _READERS:
        raise ValueError(f"unknown reader {name!r}; known: {', '.join(sorted(_READERS))}")
    return _READERS[name](spark, *args, **options)


def block_type(category: Column | str) -> Column:
    """Block type of a parser category; unknown ones are text."""
    col = F.col(category) if isinstance(category, str) else category
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CATEGORIES.items()))
    return F.coalesce(F.try_element_at(table, F.lower(col)), F.lit("text"))


def page_index(value: Column | str) -> Column:
    """0-based page of a 1-based number, a text with a number or the head of a list in text; 0 where there is none."""
    col = F.col(value) if isinstance(value, str) else value
    number = F.regexp_extract(col.cast("string"), r"-?\d+", 0)
    return F.greatest(F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(1)) - 1, F.lit(0))


def content_list_blocks(documents: DataFrame, key: str, payload: str) -> DataFrame:
    """Blocks of a parser's JSON content list; entries of type ``page_number`` are skipped."""
    listed = documents.select(F.col(key).alias("doc_id"), F.posexplode(F.from_json(payload, CONTENT_LIST)).alias("block_pos", "b"))
    kind = block_type("b.type")
    table = F.when(kind == "table", F.coalesce("b.table_body", "b.text", F.lit("")))
    return listed.filter("coalesce(b.type, '') != 'page_number'").select(
        "doc_id", "block_pos", kind.alias("type"), F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("b.page_idx", F.lit(0)).alias("page_idx"), F.col("b.text_level").alias("text_level"),
        (kind == "table").alias("is_table"), table.alias("table_html"), F.col("b.img_path").alias("image_path"), F.when(F.size("b.bbox") == 4, F.col("b.bbox")).alias("bbox"),
    )


def markdown_blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of markdown: headings, runs of table rows, images and lines of text, in order.

    A run of rows that begin and end with a bar is one table; everything else is line by line.
    """
    lines = documents.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r\n|\n")).alias("at", "line"))
    bare = F.trim("line")
    row = bare.rlike(r"^\|.*\|$")
    ordered = Window.partitionBy("doc_id").orderBy("at")
    marked = lines.select("doc_id", "at", bare.alias("bare"), row.alias("row"))
    # A run keeps the number of the last line outside tables.
    runs = marked.withColumn("run", F.sum(F.when(F.col("row"), 0).otherwise(1)).over(ordered))
    tables = runs.filter("row").groupBy("doc_id", "run").agg(F.min("at").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "bare"))), lambda x: x["bare"]), "\n").alias("text"))
    level = F.length(F.regexp_extract("bare", r"^(#{1,6})\s", 1))
    image = F.regexp_extract("bare", r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", 2)
    alt = F.regexp_extract("bare", r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", 1)
    kind = F.when(level > 0, "title").when(image != "", "image").otherwise("text")
    plain = F.when(level > 0, F.trim(F.regexp_replace("bare", r"^#{1,6}\s+", ""))).when(image != "", alt).otherwise(F.col("bare"))
    single = runs.filter("NOT row AND bare != ''").select("doc_id", "at", kind.alias("type"), plain.alias("text"), F.nullif(level, F.lit(0)).alias("text_level"), F.nullif(image, F.lit("")).alias("image_path"))
    every = single.unionByName(tables.select("doc_id", "at", F.lit("table").alias("type"), "text", F.lit(None).cast("int").alias("text_level"), F.lit(None).cast("string").alias("image_path")))
    return every.withColumn("block_pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).drop("at")


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """The first block of each type, page, image and stripped text per document."""
    key = ["doc_id", "type", "page_idx", "image_path", "stripped"]
    named = blocks.withColumn("stripped", F.trim(F.coalesce("text", F.lit(""))))
    first = Window.partitionBy(*key).orderBy("block_pos")
    return named.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "stripped")


# Names under which providers give the parts of a record.
RECORD_KEYS = {
    "nested": ("blocks", "pages", "layouts", "paragraphs", "layoutInfo", "visualLayoutInfo", "outputFormatResult", "outputImageUrls"),
    "type": ("type", "category", "blockType", "layoutType", "class"),
    "text": ("text", "content", "markdown", "html", "textContent", "contentText"),
    "html": ("html", "tableHtml", "table_html"),
    "image": ("imagePath", "image_path", "imgPath", "img_path", "imageUrl", "image_url", "pageImageUrl", "page_image_url", "originImageUrl", "origin_image_url", "url", "src"),
    "page": ("page", "pageNo", "pageNumber", "pageNum", "pageIdCurDoc", "page_id_cur_doc"),
}
RECORD_TYPES = {
    "title": "title", "header": "title", "heading": "title", "table": "table", "tablebody": "table", "table_html": "table",
    "image": "image", "figure": "image", "pic": "image", "picture": "image", "figurecaption": "image", "figure_caption": "image",
}


def _given(record: dict, what: str):
    return next((record[k] for k in RECORD_KEYS[what] if record.get(k) is not None), None)


def _page_of(record: dict, inherited: int) -> int:
    for value, first in ((record.get("page_idx"), 0), (_given(record, "page"), 1)):
        if value is None:
            continue
        value = value[0] if isinstance(value, list) and value else value
        try:
            return max(int(value) - first, 0)
        except (TypeError, ValueError):
            return inherited if first == 0 else 0
    return inherited


def walk_records(data) -> Iterator[tuple[str, str, int, str | None, str | None]]:
    """(type, text, page, table html, image path) of the leaves of nested records, in order.

    A record that holds records gives them its page; leaves without text are kept only as images. The walk
    keeps its own stack, so depth is no limit.
    """
    stack = [(data, 0)]
    while stack:
        record, page = stack.pop()
        if isinstance(record, list):
            stack.extend((r, page) for r in reversed(record))
            continue
        if not isinstance(record, dict):
            continue
        page = _page_of(record, page)
        inner = _given(record, "nested")
        if isinstance(inner, (list, dict)):
            stack.append((inner, page))
            continue
        image = _given(record, "image")
        name = str(_given(record, "type") or ("image" if image else "text")).lower()
        kind = RECORD_TYPES.get(name, "text")
        text = str(_given(record, "text") or "").strip()
        if not text and kind != "image":
            continue
        table = str(_given(record, "html") or text) if kind == "table" else None
        yield kind, text, page, table, None if image is None else str(image)


def nested_record_blocks(documents: DataFrame, key: str, payload: str) -> DataFrame:
    """Blocks of a provider's nested JSON; each type, page, image and text once per document. Broken JSON gives none."""

    def flatten(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for doc, raw in zip(pdf["doc_id"], pdf["payload"]):
                try:
                    data = json.loads(raw) if raw else []
                except ValueError:
                    continue
                rows += [(doc, k, *leaf) for k, leaf in enumerate(walk_records(data))]
            yield pd.DataFrame(rows, columns=["doc_id", "block_pos", "type", "text", "page_idx", "table_html", "image_path"])

    fields = documents.select(F.col(key).alias("doc_id"), F.col(payload).alias("payload"))
    kind = fields.schema["doc_id"].dataType.simpleString()
    blocks = fields.mapInPandas(flatten, f"doc_id {kind}, block_pos int, type string, text string, page_idx int, table_html string, image_path string")
    return distinct_blocks(blocks)


def provider_blocks(documents: DataFrame, key: str, markdown: str, payload: str) -> DataFrame:
    """Blocks of a provider's answer: its markdown first, then what only its nested JSON has; each once per document."""
    columns = ["doc_id", "block_pos", "type", "text", "page_idx", "table_html", "image_path"]
    first = markdown_blocks(documents, key, markdown).withColumns({"page_idx": F.lit(0), "table_html": F.lit(None).cast("string")}).select(*columns)
    second = nested_record_blocks(documents, key, payload).select(*columns).withColumn("block_pos", F.col("block_pos") + 1_000_000_000)
    every = distinct_blocks(first.unionByName(second))
    return every.withColumn("block_pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_pos")) - 1)


@register_reader("images")
def read_images(spark: SparkSession, path: str) -> DataFrame:
    """One image block per image file: ``doc_id, block_pos, type, text, page_idx, image_path``; other files give none."""
    files = spark.read.format("binaryFile").load(path).select("path")
    name = F.regexp_extract("path", r"[^/]+$", 0)
    images = files.filter(F.lower(name).rlike(r"\.(png|jpe?g|gif|bmp|webp|tiff?)$"))
    return images.select(name.alias("doc_id"), F.lit(0).alias("block_pos"), F.lit("image").alias("type"), F.lit("").alias("text"), F.lit(0).alias("page_idx"), F.col("path").alias("image_path"))


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[str] = []
        self.title: list[str] = []
        self.hidden = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN_TAGS:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]
        if tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN_TAGS and self.hidden:
            self.hidden -= 1
        elif tag == "title":
            self.in_title = False
        if tag in BLOCK_TAGS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.parts.append(data)


def web_page(markup: str | None) -> tuple[str, str, list[str]]:
    """(title, text, links) of a page; invisible parts are left out, blanks collapsed, blocks on their own lines."""
    page = _Page()
    page.feed(markup or "")
    page.close()
    lines = (" ".join(line.split()) for line in "".join(page.parts).split("\n"))
    return " ".join("".join(page.title).split()), "\n".join(line for line in lines if line), list(dict.fromkeys(page.links))


def web_blocks(pages: DataFrame, url: str, markup: str) -> DataFrame:
    """``url, title, text, links`` of fetched pages."""

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [web_page(m) for m in pdf["markup"]]
            yield pd.DataFrame({"url": pdf["url"], "title": [f[0] for f in found], "text": [f[1] for f in found], "links": [f[2] for f in found]})

    return pages.select(F.col(url).alias("url"), F.col(markup).alias("markup")).mapInPandas(extract, "url string, title string, text string, links array<string>")


def is_public_url(url: Column | str) -> Column:
    """Web addresses that don't name this host or a private network (by their text; nothing is resolved)."""
    col = F.lower(F.col(url) if isinstance(url, str) else url)
    host = F.regexp_extract(col, r"^https?://(?:[^/@]*@)?(\[[^\]]+\]|[^:/?#]+)", 1)
    private = host.rlike(r"^(localhost|.*\.local|.*\.localhost|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2\d|3[01])\..*|169\.254\..*|0\..*|22[4-9]\..*|2[3-5]\d\..*|\[.*\])$")
    return (host != "") & ~private


def crawl(pages: DataFrame, seeds: DataFrame, depth: int = 2, include: list[str] | None = None, exclude: list[str] | None = None, most: int = 50) -> DataFrame:
    """``url, level`` of the first ``most`` stored pages reached from ``seeds.url`` over links of the same host, breadth first.

    ``pages``: ``url, links``. Fragments are dropped; one join per level.
    """
    clean = lambda c: F.regexp_replace(c, "#.*$", "")
    host = lambda c: F.regexp_extract(c, r"^https?://([^/?#]+)", 1)
    ok = is_public_url("url")
    for word in exclude or []:
        ok = ok & ~F.contains("url", F.lit(word))
    if include:
        ok = ok & F.exists(F.array(*[F.lit(w) for w in include]), lambda w: F.contains("url", w))
    linked = pages.select(clean(F.col("url")).alias("from_url"), F.explode("links").alias("to")).select("from_url", clean(F.col("to")).alias("url"))
    graph = linked.filter(host(F.col("from_url")) == host(F.col("url"))).filter(ok).distinct().withColumnRenamed("url", "to_url")
    graph = written(graph, "crawl-links")
    level = seeds.select(clean(F.col("url")).alias("url")).distinct().withColumn("level", F.lit(0))
    seen = level
    for k in range(1, depth + 1):
        reached = level.join(graph, F.col("url") == F.col("from_url")).select(F.col("to_url").alias("url")).distinct()
        level = written(reached.join(seen, "url", "left_anti").withColumn("level", F.lit(k)), "crawl-level")  # read by every later level
        seen = seen.unionByName(level)
    stored = seen.join(pages.select(clean(F.col("url")).alias("url")).distinct(), "url", "left_semi")
    return stored.orderBy("level", "url").limit(most)


def office_text(data: bytes, extension: str) -> str:
    """Text of an OpenXML file, or the readable words of an older binary one."""
    if extension in ("docx", "pptx", "xlsx"):
        out = []
        with zipfile.ZipFile(BytesIO(data)) as z:
            for name in sorted(n for n in z.namelist() if n.endswith(".xml") and re.search(r"(document|slide\d+|sharedStrings|sheet\d+)\.xml$", n)):
                raw = z.read(name).decode("utf-8", "replace")
                raw = re.sub(r"</(?:w:p|a:p|si|row)>", "\n", raw)
                out.append(html.unescape(re.sub(r"<[^>]+>", "", raw)))
        return "\n".join(line.strip() for line in "\n".join(out).split("\n") if line.strip())
    words = re.findall(r"[A-Za-z0-9一-鿿]{2,}", data.decode("utf-16-le", "ignore")) or re.findall(r"[A-Za-z0-9一-鿿]{2,}", data.decode("utf-8", "ignore"))
    return " ".join(words)


@register_reader("office")
def read_office(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, failure`` of office files; a broken file gives a null text and its failure."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for p, data in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((p, office_text(data, p.rsplit(".", 1)[-1].lower()), None))
                except (zipfile.BadZipFile, KeyError, ValueError) as e:
                    rows.append((p, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "failure"])

    return files.mapInPandas(extract, "path string, text string, failure string")


@register_reader("jsonl_eval")
def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records, one JSON object a line; blank lines are skipped, a missing file has no records."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.globStatus(target):
        return spark.createDataFrame([], EVAL_SCHEMA)
    return spark.read.schema(EVAL_SCHEMA).json(path).filter("id IS NOT NULL")


@register_reader("backup_csv")
def read_backup(spark: SparkSession, path: str, version: str = "1", size: int | None = None) -> DataFrame:
    """Chunks of a backup: schema version and vector length are checked, pages become 0-based."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    vector = F.from_json("embedding", "array<float>")
    checked = raw.withColumn("__ok", F.assert_true(F.col("schemaVersion") == version, F.lit("schema version")))
    vector_ok = vector.isNotNull() if size is None else F.coalesce(F.size(vector) == size, F.lit(False))
    checked = checked.withColumn("__dim", F.assert_true(vector_ok, F.lit("embedding")))
    # The checks are columns, so they run with the rows they check.
    kept = checked.filter("__ok IS NULL AND __dim IS NULL")
    return kept.select("id", "content", (F.col("page").cast("int") - 1).alias("page"), F.from_json("related_ids", "array<string>").alias("related_ids"), vector.alias("embedding"))


def resolve_settings(wanted: DataFrame, *layers: DataFrame) -> DataFrame:
    """``key, value, source``: the first layer (``key, value``) that has a setting, else its ``default``."""
    out = wanted
    for k, layer in enumerate(layers):
        out = out.join(layer.select("key", F.col("value").alias(f"__{k}")), "key", "left")
    value = F.coalesce(*[F.col(f"__{k}") for k in range(len(layers))], F.col("default"))
    source = F.coalesce(*[F.when(F.col(f"__{k}").isNotNull(), F.lit(f"layer{k + 1}")) for k in range(len(layers))], F.lit("default"))
    return out.select("key", value.alias("value"), source.alias("source"))
