"""Usage analytics over append-only logs: rollups, breakdowns, quotas, replays and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly_rollup(calls: DataFrame, keys: Sequence[str], at: str = "created_at") -> DataFrame:
    """Calls per hour and key: count, tokens, latency and errors.

    ``calls`` has ``tokens, latency_ms, status``. Null keys become empty text, so a bucket has one key.
    """
    named = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    return calls.groupBy(F.date_trunc("hour", at).alias("hour_bucket"), *named).agg(
        F.count("*").alias("request_count"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.round(F.coalesce(F.sum("latency_ms"), F.lit(0.0)), 2).alias("latency_ms_sum"),
        F.count_if(F.col("status") != "success").alias("error_count"),
    )


def rebuild_hours(stored: DataFrame, calls: DataFrame, keys: Sequence[str], start, end, at: str = "created_at") -> DataFrame:
    """The stored rollup with the hours of ``[start, end)`` computed anew; the bounds are widened to whole hours."""
    begin = F.date_trunc("hour", F.lit(start).cast("timestamp"))
    stop = F.date_trunc("hour", F.lit(end).cast("timestamp") + F.expr("INTERVAL 3599999999 MICROSECONDS"))
    inside = lambda c: (F.col(c) >= begin) & (F.col(c) < stop)
    fresh = hourly_rollup(calls.filter(inside(at)), keys, at)
    return stored.filter(~inside("hour_bucket")).unionByName(fresh)


def usage_breakdown(calls: DataFrame, dimensions: Sequence[str], default: str = "console") -> DataFrame:
    """``dimension, value, ...``: the same figures by each dimension and in total, in one pass of grouping sets.

    Latency averages leave zeros out; a null dimension value is the ``default``.
    """
    listed = [F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value"))]
    listed += [F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit(default)).alias("value")) for d in dimensions]
    spread = calls.select("tokens", "latency_ms", "status", F.explode(F.array(*listed)).alias("d"))
    return spread.groupBy("d.dimension", "d.value").agg(
        F.count("*").alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.round(F.coalesce(F.avg(F.nullif("latency_ms", F.lit(0.0))), F.lit(0.0)), 4).alias("avg_latency"),
        F.round(F.count_if(F.col("status") == "success") / F.count("*"), 4).alias("success_rate"),
    )


def expected_stages(usage: DataFrame, stages: Sequence[str], stage: str = "stage") -> DataFrame:
    """Usage of every expected stage, with zeros for those that have none; unexpected ones follow."""
    wanted = usage.sparkSession.createDataFrame([(s, k) for k, s in enumerate(stages)], f"{stage} string, place int")
    joined = usage.join(F.broadcast(wanted), stage, "full_outer")
    figures = [c for c in usage.columns if c != stage]
    return joined.select(stage, F.coalesce("place", F.lit(len(stages))).alias("place"), *[F.coalesce(c, F.lit(0)).alias(c) for c in figures], F.col(figures[0]).isNull().alias("placeholder"))


def quota_windows(calls: DataFrame, key: str, at: str, window: str, limit: int, order: str) -> DataFrame:
    """Calls with their place in the tumbling window of their key, and whether the limit lets them pass."""
    start = F.window(at, window).getField("start")
    place = Window.partitionBy(key, "window_start").orderBy(at, order)
    counted = calls.withColumn("window_start", start)
    return counted.withColumn("place", F.row_number().over(place)).withColumn("allowed", F.col("place") <= limit)


def replayed(calls: DataFrame, nonce: Sequence[str], at: str, order: str, seconds: int) -> DataFrame:
    """Add ``replay``: the nonce was used in the ``seconds`` before; every use, replay or not, starts a new term."""
    last = F.lag(at).over(Window.partitionBy(*nonce).orderBy(at, order))
    return calls.withColumn("replay", F.coalesce(F.col(at) <= last + F.make_interval(secs=F.lit(seconds)), F.lit(False)))


def log_filter(logs: DataFrame, start=None, end=None, at: str = "created_at", **equal) -> DataFrame:
    """Rows that meet every given condition; conditions of None are left out."""
    condition: Column = F.lit(True)
    for name, value in equal.items():
        if value is not None:
            condition = condition & (F.col(name) == value)
    if start is not None:
        condition = condition & (F.col(at) >= F.lit(start).cast("timestamp"))
    if end is not None:
        condition = condition & (F.col(at) <= F.lit(end).cast("timestamp"))
    return logs.filter(condition)


def page_of(df: DataFrame, order: Sequence[Column | str], page: int, size: int, most: int = 100) -> DataFrame:
    """One page of a listing; page and size are clamped to sensible bounds."""
    size = max(1, min(size, most))
    page = max(1, page)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def base_listing(bases: DataFrame, documents: DataFrame) -> DataFrame:
    """Bases that aren't deleted, with the number of documents and chunks and the last update.

    ``bases``: ``id, name, status, deleted_at``; ``documents``: ``kb_id, id, chunk_count, updated_at``.
    """
    totals = documents.groupBy("kb_id").agg(F.count("*").alias("documents"), F.sum("chunk_count").alias("chunks"), F.max("updated_at").alias("last_updated"))
    kept = bases.filter("deleted_at IS NULL")
    joined = kept.join(totals, kept["id"] == totals["kb_id"], "left")
    return joined.select("id", "name", "status", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"), "last_updated")


def health_counts(rows: DataFrame, group: str, state: str, at: str, as_of, idle_seconds: int) -> DataFrame:
    """Rows per state and how many of the open ones were idle for too long at ``as_of``."""
    idle = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(at)
    return rows.groupBy(group).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(state) == "success").alias("succeeded"),
        F.count_if(F.col(state) != "success").alias("failed"),
        F.count_if((F.col(state) != "success") & (idle >= idle_seconds)).alias("stale"),
    )
