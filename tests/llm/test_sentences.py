import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkweave.llm.sentences import language, sentence_spans, split_sentences


def units(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("One line\nwraps here. Next one.", ["One line\nwraps here.", "Next one."]),
        ("Heading\r\n\r\n• entry\r\n \r\nBody text.", ["Heading", "• entry", "Body text."]),
        ("wrapped\r\nline. End.", ["wrapped\r\nline.", "End."]),
        ("The Dept. Manual, i.e. the book, was read at 9 a.m. on site. Done.", ["The Dept. Manual, i.e. the book, was read at 9 a.m. on site.", "Done."]),
        ("It reached 87.7 mg/L. The pump (see No. 73. Note it.) failed.", ["It reached 87.7 mg/L.", "The pump (see No. 73. Note it.) failed."]),
        ("Version 2.7.2 of plan.v2.pdf replaces Vol. II of it. Yes!", ["Version 2.7.2 of plan.v2.pdf replaces Vol. II of it.", "Yes!"]),
        ("流量为68.4mL/min．依据7 mL/min. 然后No．3。", ["流量为68.4mL/min．", "依据7 mL/min.", "然后No．3。"]),
        ("It waits ... and goes. Really?! Yes.", ["It waits ... and goes.", "Really?!", "Yes."]),
        ('He said "Stop it. Check it." Then he left.', ['He said "Stop it. Check it."', "Then he left."]),
        ("Am 19. Mai in der 15. Schicht usw. Wurde z. B. geprüft.", ["Am 19. Mai in der 15. Schicht usw.", "Wurde z. B. geprüft."]),
        ("Es steht: „Zuerst aus. Dann prüfen.“ Siehe Abb. 3.", ["Es steht: „Zuerst aus. Dann prüfen.“", "Siehe Abb. 3."]),
        ("他问：“好吗？”答说好；再见。1. 冷却，封存。严禁！！“先做。再做。”这一要求。", ["他问：“好吗？”答说好；再见。", "1. 冷却，封存。", "严禁！！", "“先做。再做。”这一要求。"]),
        ("参见第7-2节（注。）应查……随后.下一句｡完", ["参见第7-2节（注。）应查……随后.", "下一句｡", "完"]),
        ("（注を参照。）。なぜ！？「止める。次。」と。", ["（注を参照。）。", "なぜ！？", "「止める。次。」と。"]),
        ("क्र. 25 के अनुसार। “पहले। फिर।” और मान्य।", ["क्र. 25 के अनुसार।", "“पहले। फिर।” और मान्य।"]),
        ("هل تم؟ «أوقف. ثم افحص.» وهذا ملزم.", ["هل تم؟", "«أوقف. ثم افحص.» وهذا ملزم."]),
        ("Stop!, and ran. What?: yes.", ["Stop!, and ran.", "What?: yes."]),
        ("Use the tab. Then press enter. See the tab. 4.", ["Use the tab.", "Then press enter.", "See the tab. 4."]),
        ("He bought a new str. The end is near to it.", ["He bought a new str.", "The end is near to it."]),
        ("The letter was sent to Gov. Smith. It is here.", ["The letter was sent to Gov. Smith.", "It is here."]),
        ("Die Pumpe steht in der Werkstr. Siehe Tab. 3 und Abb. 2 mit den Werten.", ["Die Pumpe steht in der Werkstr.", "Siehe Tab. 3 und Abb. 2 mit den Werten."]),
        ("Насос показан (рис. 5) на схеме, см. Приложение. Проверьте.", ["Насос показан (рис. 5) на схеме, см. Приложение.", "Проверьте."]),
        ("The word Bd. Then und so weiter of the list is here. Voilà m. Dupont.", ["The word Bd.", "Then und so weiter of the list is here.", "Voilà m. Dupont."]),
        ("คู่มือ PDF ระบุว่า ห้องควบคุม ทุก 12 เดือน", ["คู่มือ PDF ระบุว่า", "ห้องควบคุม", "ทุก 12 เดือน"]),
    ],
)
def test_rules(text, expected):
    assert units(text) == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 .!?。“”(\")\n\r\tกข।…", max_size=80))
def test_spans_cover_everything_but_white_space(text):
    spans = sentence_spans(text)
    last = 0
    for a, b in spans:
        assert last <= a < b and not text[last:a].strip() and text[b - 1].strip()
        last = b
    assert not text[last:].strip()


def test_defined_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t\n", 0), (4, "A. " * 20000, 0), (None, "Hi there. Bye.", 0), (5, "Same. Row.", 0), (5, "Same. Row.", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sentence_no int")
    out = split_sentences(df, "doc_id", "text").collect()
    assert {r.item_id for r in out} == {4, 5, None}
    assert sum(r.item_id == 5 for r in out) == 4
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_language_by_words_then_by_column():
    assert language("Der Wert ist zu hoch", "en") == "de" and language("Abb. 3", "German") == "de"
    assert language("阀门 ABC", None) == "" and language("", "xx") == "" and language("the pump and the valve", "de-DE") == "en"
