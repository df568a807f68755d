import random

import numpy as np

import pytest

from chunkweave.llm import scan_noise as noise
from chunkweave.llm.scan_noise import GlyphReader, chapter_form, glyph_class, label_furniture, printed_number, repair_scans, repaired_text, scan_noise

SCHEMA = "id string, document_id string, content string, source string, page int, title string, is_table_chunk boolean, is_image_chunk boolean, layer string, token string"


@pytest.mark.parametrize(
    ("line", "value"),
    [("12", 12), ("  — 119 —", 119), ("· l50 ·", 150), ("121 / 195", 121), ("第 24 页", 24), ("Page 7", 7), ("xiv", 14), ("１３５\r", 135), ("第十二页", 12), ("57.7", None), ("12.", None), ("valve", None), ("", None), ("3 kPa", None)],
)
def test_printed_numbers(line, value):
    got = printed_number(line)
    assert (got[0] if got else None) == value


def test_titles_are_equal_up_to_glyphs():
    assert glyph_class("Introduction to Permanent Permit") == glyph_class("INTRODUCTION TO PCRMANENT PERMIT")
    assert glyph_class("第七章 检测指标") == glyph_class("第 七 章  捡测指棕")
    assert glyph_class("Manual") != glyph_class("Record")


def scans():
    rng = random.Random(2)
    words = "pump valve sensor record laboratory supervisor inspection pressure warehouse document".split()
    rows = []
    for k in range(60):
        body = " ".join(rng.choice(words) for _ in range(40))
        rows.append((f"p{k}", "d", f"The {body}.\n检测设备和压力阀门由检验员检查。电源和压力。", "Pump Guide-0001.pdf", k, None, False, False, "child", "x"))
    rows[10] = ("a", "d", "Pump Guide\n14\nThe supervisor reads the labo-\nratory rec0rd of the well-\nknown valve and the prcssure.\nCHAPTER 2 PUMP ROOM    15\n15\n设备由捡验员检查。", "Pump Guide-0001.pdf", 10, None, False, False, "child", "x")
    rows[20] = ("b", None, "The inspec-\n24\ntion of the valve\n472\nand the pump.\nl5\n", "Pump Guide-0001.pdf", 20, None, False, False, "child", "x")
    rows[30] = ("c", "d", "Pump Guide\nThe record", "Pump Guide-0001.pdf", 0, None, False, False, "parent", "x")
    rows += [("n1", "d", None, None, None, None, None, None, None, None), ("n2", None, "", None, None, None, None, None, None, None), (None, "d", "x\n1", None, None, None, None, None, None, None)]
    rows += [("t", "d", "| 14 |\n14", "Pump Guide-0001.pdf", 10, None, True, False, "child", "x"), rows[10], ("big", "d", "The valve opens.\n" * 30000, "Other-0002.pdf", 1, None, False, False, "child", "x")]
    return rows


def test_labels(spark):
    df = spark.createDataFrame(scans(), SCHEMA)
    got = sorted((r.id, r.line_no, r.noise) for r in scan_noise(df).collect())
    assert got == [
        ("a", 1, "header"), ("a", 2, "page_number"), ("a", 3, "hyphen"), ("a", 4, "glyph"), ("a", 5, "glyph"), ("a", 6, "header"), ("a", 7, "page_number"), ("a", 8, "glyph"),
        ("b", 1, "hyphen"), ("b", 2, "page_number"),
    ]
    assert scan_noise(df.limit(0)).count() == 0


def test_repair(spark):
    df = spark.createDataFrame(scans(), SCHEMA)
    text = {r.id: r.text for r in repair_scans(df).collect()}
    assert "laboratory record" in text["a"]
    assert "检验员" in text["a"] and "Pump Guide" not in text["a"] and "14" not in text["a"]
    assert "inspection of the valve" in text["b"] and text["t"].startswith("|") and text["n1"] is None


def test_reflow():
    wrapped = "The first line of the text goes on\nand ends here.\nA second paragraph of the text starts\nand goes on.\n"
    assert repaired_text(wrapped, set(), set(), {}, GlyphReader({})) == "The first line of the text goes on and ends here.\n\nA second paragraph of the text starts and goes on."


def test_body_lines_are_no_running_heads():
    body = ["The manual says more.", "Chapter 3 describes how the valve", "is opened and closed by the operator", "of the plant. It goes on."]
    assert label_furniture(body, 3, set(), 0, (None, None)) == [None] * 4
    han = ["手册对此有详细的规定和说明，并且要求操作人员", "第三章 讨论了设备检修的周期以及人员的培训要求", "和记录。"]
    assert label_furniture(han, 3, set(), 0, (None, None)) == [None] * 3
    assert label_furniture(["第九章 检查", *han], 3, set(), 0, (None, None))[0] == "header"
    assert label_furniture(["CHAPTFR 2 Pump Room", "CHAPTCR 2 PUMP ROOM   4", "Chapter 4 Low-voltage Alarm", *body], 3, set(), 0, (None, None))[:3] == [None, "header", "header"]
    assert chapter_form("Cbaptcr 7 Safety") == chapter_form("Chapter 7 Safety") and chapter_form("Chapter seven") is None


def ambiguous():
    """Texts in which ``lcad`` may be *load* or *lead*, and ``arc`` is no misreading of the frequent *are*."""
    rng = random.Random(5)
    rows = []
    for k in range(120):
        lines = []
        for _ in range(12):
            lines.append("the pump load sensor shows " + rng.choice(["high", "low"]) + " values")
            lines.append("old lead paint contains " + rng.choice(["toxic", "heavy"]) + " metal")
            lines.append("rules are strict when valves are closed")
            lines.append("welding smoke voltage needs " + rng.choice(["masks", "gloves"]) + " daily")
        rows.append((f"r{k}", "d", "\n".join(lines), "Guide-0001.pdf", k, None, False, False, "child", "x"))
    rows.append(("x", "d", "the pump lcad sensor shows high values\nold lcad paint contains heavy metal\nwelding arc voltage needs masks daily", "Guide-0001.pdf", 300, None, False, False, "child", "x"))
    return rows


def test_vectors_decide_in_context(spark, monkeypatch):
    df = spark.createDataFrame(ambiguous(), SCHEMA)
    read = {(r.id, r.line_no): (r.token, r.correct) for r in noise._scan(df)["waiting"].filter("correct IS NOT NULL").collect()}
    assert read == {("x", 1): ("lcad", "load"), ("x", 2): ("lcad", "lead")}

    fitted = noise.word_model

    def without(counts):
        model = fitted(counts)
        model.basis = np.zeros_like(model.basis)
        return model

    monkeypatch.setattr(noise, "word_model", without)
    blind = {(r.id, r.line_no): (r.token, r.correct) for r in noise._scan(df)["waiting"].filter("correct IS NOT NULL").collect()}
    assert blind != read and ("x", 3) in blind  # without vectors one reading is wrong and a right word is called misread


def test_vectors_propose_glyphs():
    rng = random.Random(1)
    around = "监控设备压力阀门温度电源记录"
    counts: dict[str, int] = {}
    for _ in range(4000):
        a, b, c = rng.choice(around), "检", rng.choice("查测修")
        for p in (a + b, b + c):
            counts[p] = counts.get(p, 0) + 1
    counts["备捡"] = counts["捡查"] = 1
    reader = GlyphReader(counts)
    assert noise.han_readings(reader, "设备捡查") == [(2, "检")]
    # Vectors that point elsewhere propose other glyphs, and the misreading stays.
    reader.rows = -reader.rows
    reader.seen.clear()
    assert noise.han_readings(reader, "设备捡查") == []
