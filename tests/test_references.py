from datetime import datetime as dt

import pytest

from chunkweave.functions.ids import canonical_uuid
from chunkweave.operators.references import orphan_references

U = "ec26599a-5f4b-4164-a35d-2ab463374461"


def test_canonical_uuid(spark):
    rows = [(U,), (U.upper(),), (U.replace("-", ""),), ("{" + U + "}",), (f" \t{U}\n",), (U[:-1],), ("",), (None,), ("0" * 32,), (U + "a",)]
    got = [r[0] for r in spark.createDataFrame(rows, "v string").select(canonical_uuid("v")).collect()]
    assert got == [U] * 5 + [None] * 5


@pytest.mark.parametrize(
    ("match", "expected"),
    [("simple", {"bad"}), ("full", {"bad", "half_ok", "half_bad"}), ("partial", {"bad", "half_bad"})],
)
def test_match_semantics(spark, match, expected):
    refs = spark.createDataFrame(
        [("ok", "a", "1"), ("bad", "a", "2"), ("half_ok", None, "1"), ("half_bad", None, "9"), ("none", None, None)],
        "name string, k1 string, k2 string",
    )
    targets = spark.createDataFrame([("a", "1", "x"), ("a", "1", "y"), (None, "9", "z")], "k1 string, k2 string, name string")
    if match == "partial":  # a target with a null key column still matches on the other one
        expected = {"bad"}
    got = [r.name for r in orphan_references(refs, targets, ["k1", "k2"], match).collect()]
    assert sorted(got) == sorted(expected)
    everything = orphan_references(refs, targets.limit(0), ["k1", "k2"], match).count()
    assert everything == {"simple": 2, "full": 4, "partial": 4}[match]
    assert orphan_references(refs.limit(0), targets, ["k1", "k2"], match).count() == 0


def test_late_targets(spark):
    refs = spark.createDataFrame([("r1", "t", dt(2025, 1, 1)), ("r2", "t", dt(2025, 1, 2)), ("r3", "t", None)], "ref string, k string, at timestamp")
    targets = spark.createDataFrame([("t", dt(2025, 1, 3, 0, 0, 1)), ("t", dt(2025, 2, 1))], "k string, at timestamp")
    got = {r.ref for r in orphan_references(refs, targets, ["k"], "simple", "at", "at").collect()}
    assert got == {"r1"}
