"""Every query of the training-data problems on small tables, with what must hold of its rows."""

import os

import pytest

from chunkweave.llm import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def rows(spark):
    found = {}

    def run(name):
        if name not in found:
            found[name] = [tuple(r) for r in QUERIES[name](spark, DATA).collect()]
        return found[name]

    return run


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_has_rows_and_none_twice(rows, name):
    got = rows(name)
    assert len(got) == len(set(got))
    assert got


def test_groups_are_named_by_their_least_id(rows):
    assert all(first < i for first, i in rows("p2_found"))
    assert {first for first, _ in rows("p2_found")}.isdisjoint(i for _, i in rows("p2_found"))


def test_neighbours(rows):
    assert all(a < b for a, b in rows("p3_found"))
    counts = {}
    for i, other, _ in rows("p3_ten"):
        assert i != other
        counts[i] = counts.get(i, 0) + 1
    assert set(counts.values()) == {10}
    recall = {name: r for name, _, r in rows("p3_recall")}
    assert recall["p3_found, its pairs"] >= 0.97 and recall["p3_ten"] >= 0.9 and recall["p3_neighbours"] >= 0.9


def test_leaks_are_proximity_matches_too(rows):
    assert {r[:2] for r in rows("p7_found")} <= {r[:2] for r in rows("p7_proximity")}


def test_kinds_of_noise(rows):
    assert {r[2] for r in rows("p5_found")} <= {"header", "page_number", "hyphen", "glyph"}
    assert all(line > 0 for _, line, _ in rows("p5_found"))


def test_sentences_end_where_they_are_found(rows):
    assert {(d, e) for d, e in rows("p8_found")} == {(d, e) for d, _, e, _ in rows("p8_sentences")}
