import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkweave.llm.packing import PATTERN, VOCABULARY, encoding, fill_report, packed, packing_plan, token_pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_uses_every_text_once(lengths):
    histogram = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, np.int64)
    used = np.zeros(65, np.int64)
    for pattern, n in packing_plan(histogram):
        assert n > 0 and sum(a * b for a, b in pattern) <= 64
        for a, b in pattern:
            used[a] += n * b
    assert (used == histogram).all()


def test_plan_is_tight_and_bounded():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(5.5, 1.0, 20000).astype(int), 1, 2048)
    plan = packing_plan(np.bincount(lengths, minlength=2049))
    containers = sum(n for _, n in plan)
    assert lengths.sum() / (containers * 2048) > 0.98
    assert len(plan) < 3 * 2048


def test_packing_against_definition(spark):
    rng = random.Random(3)
    texts = ["pump " * rng.randint(1, 60) for _ in range(300)] + ["检查阀门" * 900, "long text " * 3000, " "]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(5, texts[5], "again"), (900, None, ""), (901, "", ""), (None, "lost", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container string")
    out = packed(df, "doc_id", "text").collect()
    spans = {}
    for r in out:
        spans.setdefault(r.container, []).append((r.start, r.start + r.n_tokens))
    for own in spans.values():  # no overlap, within the capacity
        own.sort()
        assert own[-1][1] <= 2048 and all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    assert len({(r.item_id, r.piece_no) for r in out}) == len(out)
    enc = encoding(VOCABULARY, PATTERN)
    for k, t in enumerate(texts):
        mine = sorted((r.piece_no, r.token_start, r.n_tokens) for r in out if r.item_id == k)
        tokens = enc.encode_ordinary(t)
        assert sum(x[2] for x in mine) == len(tokens) and (len(mine) == 1 or len(tokens) > 2048)
    assert {r.item_id for r in out} == set(range(len(texts)))
    assert fill_report(packed(df, "doc_id", "text")).first().fill > 0.8
    assert packed(df.limit(0), "doc_id", "text").count() == 0


def test_cuts_keep_characters():
    enc = encoding(VOCABULARY, PATTERN)
    text = "🜚🝚" * 300
    tokens = enc.encode_ordinary(text)
    for a, b in token_pieces(text, 101):
        enc.decode_bytes(tokens[a:b]).decode("utf-8")
