"""Structured Streaming jobs: hourly rollups, replay detection, quotas and delta merges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chunkweave.operators.merge import latest, upsert


def stream_hourly(calls: DataFrame, keys: Sequence[str], at: str, late: str = "2 hours") -> DataFrame:
    """The hourly rollup of a stream; hours stay open for rows up to ``late``."""
    window = F.window(at, "1 hour")
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    return (
        calls.withWatermark(at, late)
        .groupBy(window, *named)
        .agg(F.count("*").alias("request_count"), F.sum("tokens").alias("total_tokens"), F.count_if(F.col("status") != "success").alias("error_count"))
        .select(F.col("window.start").alias("hour_bucket"), *keys, "request_count", "total_tokens", "error_count")
    )


def stream_first_uses(calls: DataFrame, nonce: Sequence[str], at: str, seconds: int) -> DataFrame:
    """Calls whose nonce was not used within the last ``seconds``; state older than that is dropped."""
    return calls.withWatermark(at, f"{seconds} seconds").dropDuplicatesWithinWatermark(list(nonce))


def stream_quota(calls: DataFrame, key: str, at: str, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """``key, at, order_id, place, allowed``: the place of each call in its key's tumbling window.

    State per key is the count of each of its open windows: a late call counts in its own window, as long as the
    watermark of ``late`` keeps it open; calls later than that are dropped. Calls of one trigger are placed in order of
    their time, those of an earlier trigger before them.
    """
    shaped = calls.withWatermark(at, late).select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), "order_id")

    def count(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = dict(zip(*state.get)) if state.exists else {}
        mark = state.getCurrentWatermarkMs() // 1000
        pdf = None if state.hasTimedOut else pd.concat(list(parts))
        if pdf is not None and len(pdf):
            pdf = pdf.sort_values(["at", "order_id"])
            places = []
            for stamp in pdf["at"]:
                own = int(stamp.timestamp()) // seconds
                used[own] = used.get(own, 0) + 1
                places.append(used[own])
            yield pdf.assign(place=places, allowed=[p <= limit for p in places])[["key", "at", "order_id", "place", "allowed"]]
        used = {w: n for w, n in used.items() if (w + 1) * seconds > mark}
        if used:
            state.update((list(used), list(used.values())))
            state.setTimeoutTimestamp((max(used) + 1) * seconds * 1000 + 1)
        elif state.exists:
            state.remove()

    return shaped.groupBy("key").applyInPandasWithState(
        count, "key string, at timestamp, order_id bigint, place int, allowed boolean", "windows array<bigint>, used array<int>", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_merge(changes: DataFrame, path: str, keys: Sequence[str], at: str, order: str, checkpoint: str) -> DataStreamWriter:
    """Each batch of changes merged into a table written under ``path/<batch>``; a repeated batch writes the same folder.

    Every batch writes the whole table: for small ones of which each version is wanted; else :func:`stream_merge_parts`.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = latest(batch, keys, at, order)
        if number:
            before = spark.read.parquet(f"{path}/{number - 1}")
            last = upsert(before, last, keys)
        last.write.mode("overwrite").parquet(f"{path}/{number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def stream_merge_parts(changes: DataFrame, path: str, keys: Sequence[str], at: str, order: str, checkpoint: str, parts: int = 64) -> DataStreamWriter:
    """Changes merged into a table of ``parts`` folders by the hash of the key; each batch rewrites only the folders it touches.

    A folder ``path/part=<p>/batch=<n>`` holds the whole part as of batch n; the newest counts, see :func:`merged_table`. A
    repeated batch reads the state before it and writes the same folder; folders older than the last two of a part are deleted.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
        last = latest(batch, keys, at, order)
        touched = sorted(r.p for r in last.select(part.alias("p")).distinct().collect())  # at most ``parts``
        folders = _part_folders(spark, path)
        before = [f"{path}/part={p}/batch={n}" for p in touched if (n := max((b for b in folders.get(p, ()) if b < number), default=None)) is not None]
        if before:
            last = upsert(spark.read.parquet(*before).select(*last.columns), last, keys)
        out = last.withColumn("part", part).withColumn("batch", F.lit(number))
        out.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(path)
        for p in touched:
            for old in sorted(b for b in folders.get(p, ()) if b < number)[:-1]:
                _hadoop_delete(spark, f"{path}/part={p}/batch={old}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def _part_folders(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Batches of each part of a merged table."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    if files.exists(root):
        for part in files.listStatus(root):
            name = part.getPath().getName()
            if name.startswith("part="):
                found[int(name[5:])] = [int(b.getPath().getName()[6:]) for b in files.listStatus(part.getPath()) if b.getPath().getName().startswith("batch=")]
    return found


def _hadoop_delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def merged_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`stream_merge_parts` keeps: the newest batch of every part."""
    newest = [f"{path}/part={p}/batch={max(batches)}" for p, batches in sorted(_part_folders(spark, path).items()) if batches]
    return spark.read.parquet(*newest)
