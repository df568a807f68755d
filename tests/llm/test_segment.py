from hypothesis import given, settings
from hypothesis import strategies as st

from chunkweave.llm.segment import cut_points, split_oversized


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab 。.\n, 字é́|", max_size=700), st.integers(20, 120))
def test_pieces_rebuild_the_text(text, limit):
    overlap = limit // 5
    cuts = cut_points(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e, _ in cuts)
    rebuilt = "".join(text[s:e][(0 if k == 0 else cuts[k - 1][1] - s) :] for k, (s, e, _) in enumerate(cuts))
    assert rebuilt == text
    for (_, e, _), (s, _, _) in zip(cuts, cuts[1:]):
        assert e - s == overlap


def test_cuts_at_the_topic_change():
    cats = "The cat chased another cat. A cat sleeps near the cat. "
    ships = "The ship crossed a harbour. A harbour shelters the ship. "
    text = cats * 6 + ships * 6
    (_, end, kind), *_ = cut_points(text, 500, 50)
    assert kind == "valley" and end == len(cats * 6)


def test_defined_cases(spark):
    rows = [("a", None, 1), ("b", "", 1), ("c", "x" * 10, 1), ("c", "x" * 10, 1), (None, "y" * 2500, 1), ("d", "word " * 40000, 1)]
    df = spark.createDataFrame(rows, "id string, content string, piece_no int")
    out = split_oversized(df, "id", "content").collect()
    assert sum(r.item_id == "c" for r in out) == 2
    assert sum(r.item_id is None for r in out) == 3
    assert max(len(r.piece) for r in out) <= 1000
    assert not [r for r in out if r.item_id in ("a", "b")]
    empty = split_oversized(df.limit(0), "id", "content")
    assert empty.count() == 0
