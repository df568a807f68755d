"""Helpers of the session: repeated keys, sizes and the shared folder."""

from types import SimpleNamespace

import pytest

from chunkweave import runtime


def test_once_per_key(spark):
    rows = [(1, "late", 5), (1, "first", 2), (1, "undated", None), (2, "only", None), (None, "kept", 1), (None, "kept too", 1)]
    df = spark.createDataFrame(rows, "k int, v string, at int").selectExpr("k", "v", "timestamp_seconds(at) AS at")
    got = sorted((r.k or 0, r.v) for r in runtime.once_per_key(df, "k", "at").collect())
    assert got == [(0, "kept"), (0, "kept too"), (1, "first"), (2, "only")]
    assert runtime.once_per_key(df.limit(0), "k", "at").count() == 0


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    nothing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context)
    with pytest.raises(RuntimeError):
        runtime.shared_folder(session)


def test_the_shared_folder_of_the_session_counts():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: "hdfs://shared"))
    assert runtime.shared_folder(session) == "hdfs://shared"
