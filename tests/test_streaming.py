from datetime import datetime as dt

from chunkweave.streaming import jobs

SCHEMA = "order_id bigint, created_at timestamp, key string, tokens bigint, status string"


def stored(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def run(df, tmp_path, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


ROWS = [
    (1, dt(2025, 1, 1, 0, 0, 10), "a", 3, "success"),
    (2, dt(2025, 1, 1, 0, 0, 20), "a", 4, "failed"),
    (3, dt(2025, 1, 1, 0, 1, 5), "a", 5, "success"),
    (4, dt(2025, 1, 1, 5, 0, 0), "b", 1, "success"),
]


def test_hourly(spark, tmp_path):
    path = stored(spark, tmp_path, ROWS)
    out = run(jobs.stream_hourly(spark.readStream.schema(SCHEMA).parquet(path), ["key"], "created_at"), tmp_path, "hourly", "complete")
    assert sorted((r[0].hour, *r[1:]) for r in out) == [(0, "a", 3, 12, 1), (5, "b", 1, 1, 0)]


def test_first_uses(spark, tmp_path):
    path = stored(spark, tmp_path, [*ROWS, ROWS[0]])
    out = run(jobs.stream_first_uses(spark.readStream.schema(SCHEMA).parquet(path), ["key"], "created_at", 600), tmp_path, "uses", "append")
    assert sorted(r[2] for r in out) == ["a", "b"]


def test_quota(spark, tmp_path):
    path = stored(spark, tmp_path, ROWS)
    out = run(jobs.stream_quota(spark.readStream.schema(SCHEMA).parquet(path), "key", "created_at", 1), tmp_path, "quota", "append")
    assert {r[2]: r[4] for r in out} == {1: True, 2: False, 3: True, 4: True}


def test_merge(spark, tmp_path):
    path = stored(spark, tmp_path, ROWS[:2])
    source = spark.readStream.schema(SCHEMA).parquet(path)
    target = str(tmp_path / "merged")

    def once():
        jobs.stream_merge(source, target, ["key"], "created_at", "order_id", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)

    once()
    stored(spark, tmp_path, ROWS[2:])
    once()
    assert {r.key: r.tokens for r in spark.read.parquet(f"{target}/1").collect()} == {"a": 5, "b": 1}


def test_late_calls_count_in_their_own_window(spark, tmp_path):
    path = stored(spark, tmp_path, ROWS[2:3])
    target = str(tmp_path / "late-out")

    def once():
        source = jobs.stream_quota(spark.readStream.schema(SCHEMA).parquet(path), "key", "created_at", 1)
        query = source.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(target)).option("checkpointLocation", str(tmp_path / "late"))
        query.trigger(availableNow=True).start().awaitTermination(120)

    once()
    stored(spark, tmp_path, [*ROWS[:2], (5, dt(2025, 1, 1, 0, 1, 30), "a", 1, "success")])
    once()
    assert {r.order_id: r.place for r in spark.read.parquet(target).collect()} == {3: 1, 1: 1, 2: 2, 5: 2}


def test_merge_by_parts(spark, tmp_path):
    path = stored(spark, tmp_path, [*ROWS[:2], (9, dt(2025, 1, 1), "c", 7, "success")])
    source = spark.readStream.schema(SCHEMA).parquet(path)
    target = str(tmp_path / "parts")

    def once():
        jobs.stream_merge_parts(source, target, ["key"], "created_at", "order_id", str(tmp_path / "cp"), 8).trigger(availableNow=True).start().awaitTermination(120)

    once()
    for rows in (ROWS[2:], [(10, dt(2025, 1, 2), "a", 6, "success")], [(11, dt(2025, 1, 3), "a", 8, "success")]):
        stored(spark, tmp_path, rows)
        once()
    assert {r.key: r.tokens for r in jobs.merged_table(spark, target).collect()} == {"a": 8, "b": 1, "c": 7}
    batches = jobs._part_folders(spark, target)
    assert max(map(len, batches.values())) == 2  # older versions of a part are gone
