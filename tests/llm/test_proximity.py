import random

from chunkweave.llm import leakage
from chunkweave.llm.leakage import build_postings, leaked_items, proximity_matches
from chunkweave.runtime import written

ITEM = "The laboratory thermometer reached forty degrees before the supervisor stopped the compressor."


def test_edited_document_is_found(spark):
    near = ITEM[:30] + " yes " + ITEM[34:62] + " no " + ITEM[66:]
    docs = spark.createDataFrame([(1, near), (2, "nothing of the sort"), (3, ITEM), (4, ""), (5, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([("q", ITEM)], "id string, query string")
    assert {r.doc_key for r in proximity_matches(docs, "doc_id", "text", items, "id", ["query"]).collect()} == {1, 3}
    assert proximity_matches(docs.limit(0), "doc_id", "text", items, "id", ["query"]).count() == 0


def test_every_edited_copy_of_many_is_found(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnoprstuvw"
    item = "".join(rng.choice(letters) for _ in range(300))

    def copy(_):
        at = rng.randint(0, 150)
        passage = list(item[at : at + 150])
        for k in range(rng.randint(5, 20), 150, 25):
            passage[k] = "z"
        filler = "".join(rng.choice("xyz0123") for _ in range(rng.randint(0, 60)))
        return filler + "".join(passage) + filler

    docs = spark.createDataFrame([(k, copy(k)) for k in range(200)], "doc_id bigint, text string")
    items = spark.createDataFrame([("q", item)], "id string, query string")
    assert {r.doc_key for r in proximity_matches(docs, "doc_id", "text", items, "id", ["query"]).collect()} == set(range(200))


def test_one_index_serves_several_test_sets(spark, monkeypatch):
    monkeypatch.setattr(leakage, "LINES", 2)  # a repetitive text comes in several groups
    docs = spark.createDataFrame([(1, "x " + ITEM + " y"), (2, "ab" * 300), (3, "nothing")], "doc_id bigint, text string")
    index = written(build_postings(docs, "doc_id", "text"), "index")
    for items, want in (([("q", ITEM)], {(1, "q")}), ([("r", "ab" * 60), ("s", ITEM[20:90])], {(2, "r"), (1, "s")})):
        asked = spark.createDataFrame(items, "id string, query string")
        found = {(r.doc_key, r.item_key) for r in leaked_items(docs, "doc_id", "text", asked, "id", ["query"], index=index).collect()}
        assert found == want
        near = {(r.doc_key, r.item_key) for r in proximity_matches(docs, "doc_id", "text", asked, "id", ["query"], index=index).collect()}
        assert found - {(2, "r")} <= near  # a text of one repeated term has no three terms
