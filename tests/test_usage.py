from datetime import datetime as dt

import pytest

from chunkweave.operators import merge, usage

CALLS = "id bigint, created_at timestamp, kb string, tokens bigint, latency_ms double, status string"


def calls(spark):
    rows = [
        (1, dt(2025, 1, 1, 0, 10), "a", 30, 120.5, "success"),
        (2, dt(2025, 1, 1, 0, 50), "a", 15, 0.0, "failed"),
        (3, dt(2025, 1, 1, 1, 0), None, None, None, "success"),
        (4, dt(2025, 1, 1, 1, 0), "a", 1, 10.0, "success"),
    ]
    return spark.createDataFrame(rows, CALLS)


def test_rollup_and_rebuild(spark):
    rollup = usage.hourly_rollup(calls(spark), ["kb"])
    got = {(r.hour_bucket.hour, r.kb): (r.request_count, r.total_tokens, r.latency_ms_sum, r.error_count) for r in rollup.collect()}
    assert got == {(0, "a"): (2, 45, 120.5, 1), (1, ""): (1, 0, 0.0, 0), (1, "a"): (1, 1, 10.0, 0)}
    old = usage.hourly_rollup(calls(spark).filter("id != 2"), ["kb"])
    rebuilt = usage.rebuild_hours(old, calls(spark), ["kb"], "2025-01-01 00:30:00", "2025-01-01 00:40:00")
    assert sorted(map(tuple, rebuilt.collect())) == sorted(map(tuple, rollup.collect()))


def test_breakdown(spark):
    got = {(r.dimension, r.value): (r.calls, r.tokens, r.avg_latency, r.success_rate) for r in usage.usage_breakdown(calls(spark), ["kb"]).collect()}
    assert got["all", ""] == (4, 46, 65.25, 0.75) and got["kb", "console"] == (1, None, 0.0, 1.0)


def test_expected_stages(spark):
    df = spark.createDataFrame([("b", 2), ("z", 1)], "stage string, calls bigint")
    got = [(r.stage, r.calls, r.placeholder) for r in usage.expected_stages(df, ["a", "b"]).orderBy("place").collect()]
    assert got == [("a", 0, True), ("b", 2, False), ("z", 1, False)]


def test_quota_and_replay(spark):
    placed = usage.quota_windows(calls(spark).withColumnRenamed("kb", "key").filter("key = 'a'"), "key", "created_at", "1 hour", 1, "id")
    assert {r.id: r.allowed for r in placed.collect()} == {1: True, 2: False, 4: True}
    assert {r.id for r in usage.replayed(calls(spark), ["kb"], "created_at", "id", 1200).filter("replay").collect()} == {4}


def test_filters_and_pages(spark):
    df = calls(spark)
    assert usage.log_filter(df, start="2025-01-01 00:30:00", kb="a", status=None).count() == 2
    assert [r.id for r in usage.page_of(df, ["id"], 2, 3).collect()] == [4]
    assert [r.id for r in usage.page_of(df, ["id"], -1, 0).collect()] == [1]
    health = usage.health_counts(df, "kb", "status", "created_at", "2025-01-01 03:00:00", 7200).filter("kb = 'a'").first()
    assert (health.total, health.succeeded, health.failed, health.stale) == (3, 2, 1, 1)


def test_upsert_and_missing(spark):
    now = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "id int, v string, w string")
    assert sorted(map(tuple, merge.upsert(now, new, ["id"]).collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    assert [r.id for r in merge.insert_missing(now, new.unionByName(new), ["id"]).collect()] == [3]
    flagged = merge.soft_delete(now.selectExpr("id", "true AS active"), new, ["id"])
    assert {r.id: r.active for r in flagged.collect()} == {1: False, 2: True}
    versions = spark.createDataFrame([("k", "1", 1), ("k", "1", 2), ("k", "2", 3)], "key string, value string, at int")
    assert [(r.value, r.version) for r in merge.version_log(versions, "key", "value", "at", "at").orderBy("version").collect()] == [("1", 1), ("2", 2)]


def test_drafts(spark):
    rows = [("t", 2, " b ", ["x"]), ("t", 1, "a", ["y", "x"]), ("t", 3, " ", None), ("t", 4, None, [])]
    got = merge.merge_drafts(spark.createDataFrame(rows, "task string, idx int, content string, related array<string>"), ["task"], "idx", "content", "related").first()
    assert (got.content, got.related_ids, got.drafts) == ("a\n\nb", ["y", "x"], 4)


def test_cascade(spark):
    documents = spark.createDataFrame([("d1",), ("d2",)], "id string")
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d2"), ("c3", None)], "id string, document_id string")
    left = merge.cascade_delete(documents, documents.filter("id = 'd1'"), {"chunks": (chunks, "document_id")})
    assert left["documents"].count() == 1 and {r.id for r in left["chunks"].collect()} == {"c2", "c3"}


@pytest.mark.parametrize("empty", [True])
def test_empty(spark, empty):
    none = calls(spark).limit(0)
    assert usage.hourly_rollup(none, ["kb"]).count() == 0 and usage.usage_breakdown(none, ["kb"]).count() == 0
