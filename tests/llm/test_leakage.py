import random

from chunkweave.llm.leakage import leaked_items, letters_and_digits, longest_run, proximity_matches


def brute(doc, item, least):
    a, b = letters_and_digits(doc), letters_and_digits(item)
    return any(b[k : k + least] in a for k in range(len(b) - least + 1))


def test_normalisation_and_runs():
    assert letters_and_digits("Ａb-Ⅳ ２.é!") == "abiv2é"
    assert longest_run("xxabcdefyy", "abcdef", 2) == 6
    assert longest_run("abc", "abc", 5) == 0


def test_against_brute_force(spark):
    rng = random.Random(4)
    words = ["pump", "valve", "阀门", "检查", "sensor", "record", "温度", "x1"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(f"q{k}", text(12), text(25) if k % 3 else None, "n") for k in range(12)]
    items += [("short", "pump", "", "n"), (None, text(40), None, "n"), items[0]]
    docs = [(k, text(30) + (items[k % 12][1 + (k % 3 != 0)] or "")[: rng.randint(0, 120)] + text(9), "c") for k in range(60)]
    docs += [(60, None, "c"), (61, "", "c"), (None, items[1][1], "c"), docs[0], (62, text(8000) + items[2][2], "c")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, pos string")
    i = spark.createDataFrame(items, "id string, query string, answer string, term string")
    got = sorted((r.doc_key, r.item_key) for r in leaked_items(d, "doc_id", "text", i, "id", ["query", "answer"]).collect())
    want = sorted({(x[0], y[0]) for x in docs for y in items if x[0] is not None and y[0] is not None and x[1] for t in y[1:3] if t and brute(x[1], t, 50)})
    assert want and got == want
    assert leaked_items(d.limit(0), "doc_id", "text", i, "id", ["query", "answer"]).count() == 0
    assert leaked_items(d, "doc_id", "text", i.limit(0), "id", ["query", "answer"]).count() == 0


def test_proximity(spark):
    item = "The laboratory thermometer reached forty degrees before the supervisor stopped the compressor."
    near = item[:30] + " yes " + item[34:62] + " no " + item[66:]
    docs = spark.createDataFrame([(1, near), (2, "nothing of the sort"), (3, item)], "doc_id bigint, text string")
    items = spark.createDataFrame([("q", item)], "id string, query string")
    got = {r.doc_key for r in proximity_matches(docs, "doc_id", "text", items, "id", ["query"]).collect()}
    assert 3 in got and 2 not in got
