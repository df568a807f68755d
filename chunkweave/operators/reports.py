"""Small projections and summaries: candidates, answers about figures, page counts, freshness, logs, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def location(page: Column | str, chunk_index: Column | str) -> Column:
    """``P.<page> · #<place>``; a null page counts 0, a null place is left out."""
    page, at = (F.col(c) if isinstance(c, str) else c for c in (page, chunk_index))
    head = F.concat(F.lit("P."), F.coalesce(page, F.lit(0)).cast("string"))
    return F.when(at.isNull(), head).otherwise(F.concat(head, F.lit(" · #"), (at + 1).cast("string")))


def candidate_view(candidates: DataFrame) -> DataFrame:
    """The columns every way of retrieval gives out, with their defaults; absent columns count as null.

    Texts become empty, numbers 0 and flags false; the document's name falls back to the source, scores to ``score``.
    """
    has = lambda c, kind: F.col(c).cast(kind) if c in candidates.columns else F.lit(None).cast(kind)
    text = lambda *cs: F.coalesce(*[F.nullif(has(c, "string"), F.lit("")) for c in cs], F.lit(""))
    number = lambda c, kind, *more: F.coalesce(has(c, kind), *[has(m, kind) for m in more], F.lit(0).cast(kind))
    keys = [c for c in ("query_id",) if c in candidates.columns]
    return candidates.select(
        *keys, "id", text("content").alias("content"), text("source").alias("source"), text("document_id").alias("document_id"),
        text("document_name", "filename", "source").alias("document_name"), number("page", "int").alias("page"), number("chunk_index", "int").alias("chunk_index"),
        location(has("page", "int"), F.coalesce(has("chunk_index", "int"), F.lit(0))).alias("location"), text("layer").alias("layer"), F.nullif(has("parent_id", "string"), F.lit("")).alias("parent_id"),
        number("score", "double").alias("score"), number("dense_score", "double", "score").alias("dense_score"), text("title").alias("title"),
        F.coalesce(has("is_table_chunk", "boolean"), F.lit(False)).alias("is_table_chunk"), F.coalesce(has("is_image_chunk", "boolean"), F.lit(False)).alias("is_image_chunk"),
        F.nullif(has("image_path", "string"), F.lit("")).alias("image_path"),
    )


def media_answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, answer, chunk_id, cannot_answer``: where the first hit of a query for a figure or table stands.

    ``queries``: ``query_id, label``; ``hits``: ``query_id, rank, id, source, page, chunk_index``.
    """
    first = hits.groupBy("query_id").agg(F.min_by(F.struct("id", "source", "page", "chunk_index"), "rank").alias("h"))
    joined = queries.join(first, "query_id", "left")
    found = F.concat(F.lit("已定位到 "), "label", F.lit("，来源："), F.coalesce("h.source", F.lit("")), F.lit("，位置："), location(F.col("h.page"), F.col("h.chunk_index")), F.lit("。[1]"))
    missing = F.col("h.id").isNull()
    return joined.select("query_id", F.when(missing, "根据现有文档无法回答该问题").otherwise(found).alias("answer"), F.col("h.id").alias("chunk_id"), missing.alias("cannot_answer"))


def of_types(relations: Column, kinds: Sequence[str]) -> Column:
    """The relations of an array of structs whose ``rel_type`` is one of ``kinds``; null gives an empty array."""
    return F.coalesce(F.filter(relations, lambda r: r["rel_type"].isin(list(kinds))), F.array())


def has_relation(relations: Column, target: Column, kind: Column | None = None) -> Column:
    """Does an array of relations hold one to ``target`` (of ``kind``)?"""
    same = lambda r: (r["dst_id"] == target) & (F.lit(True) if kind is None else r["rel_type"] == kind)
    return F.coalesce(F.exists(relations, same), F.lit(False))


def page_counts(blocks: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """``doc_id, pages``: what the parser told (``doc_id, pages``), else the last page's number plus one, else 0."""
    counted = blocks.groupBy("doc_id").agg((F.coalesce(F.max("page_idx") + 1, F.lit(0))).cast("int").alias("seen"))
    if told is None:
        return counted.withColumnRenamed("seen", "pages")
    return counted.join(told, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("pages") > 0, F.col("pages")), "seen").cast("int").alias("pages"))


def freshness(rows: DataFrame, keys: Sequence[str], stamps: Sequence[str], now: Column, most_seconds: int) -> DataFrame:
    """``*keys, synced_at, age_seconds, reason``: the latest of all stamps per key; reason is empty, *stale* or *missing*."""
    latest = F.greatest(*stamps) if len(stamps) > 1 else F.col(stamps[0])
    grouped = rows.groupBy(*keys).agg(F.max(latest).alias("synced_at"))
    age = F.greatest(F.floor(F.unix_micros(now) / 1_000_000) - F.floor(F.unix_micros("synced_at") / 1_000_000), F.lit(0)).cast("bigint")
    reason = F.when(F.col("synced_at").isNull(), "missing").when(age > most_seconds, "stale").otherwise("")
    return grouped.select(*keys, "synced_at", age.alias("age_seconds"), reason.alias("reason"))


def newest(rows: DataFrame, n: int, *stamps: str, key: str) -> DataFrame:
    """The ``n`` newest rows by the first of ``stamps`` that is known, unknown ones last, ties by key, the greatest first."""
    return rows.orderBy(F.desc_nulls_last(F.coalesce(*stamps)), F.desc(key)).limit(n)


def log_metrics(lines: DataFrame, key: str, text: str, counted: dict[str, str], highest: dict[str, str]) -> DataFrame:
    """``key`` and one number per pattern: lines that match (``counted``), the greatest number in the first group (``highest``)."""
    sums = [F.count_if(F.col(text).rlike(p)).alias(name) for name, p in counted.items()]
    tops = [F.coalesce(F.max(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("bigint")), F.lit(0)).alias(name) for name, p in highest.items()]
    return lines.groupBy(key).agg(*sums, *tops)


def running_maximum(lines: DataFrame, key: str, order: Sequence[str], value: Column) -> DataFrame:
    """Every line with ``progress``, the greatest value of its key so far; null before the first."""
    return lines.withColumn("progress", F.max(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def submission_order(shards: DataFrame, heavy_first: bool = True) -> DataFrame:
    """``turn``: the place of each shard ``doc_id, shard_no, weight`` among those of its document, the heaviest first."""
    order = [F.desc("weight"), F.col("shard_no")] if heavy_first else [F.col("shard_no")]
    return shards.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def running_totals(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``before``: the sum of ``value`` over the rows of the key ahead of each."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def merged_usage(usage: DataFrame, key: str, counters: str) -> DataFrame:
    """``key, counters``: maps of counters added up by name; null and negative counts are left out."""
    each = usage.select(key, F.explode(counters).alias("name", "n")).filter("n >= 0").groupBy(key, "name").agg(F.sum("n").alias("n"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("counters"))


def unexpired(rows: DataFrame, at: str, now: Column, seconds: int) -> DataFrame:
    """Rows of at most ``seconds`` before ``now``; rows without a time are gone."""
    return rows.filter(F.unix_micros(now) - F.unix_micros(at) <= seconds * 1_000_000)


def log_export(logs: DataFrame, fields: Sequence[str], at: str, key: str, n: int = 100_000) -> DataFrame:
    """The newest ``n`` rows with the ``fields`` allowed outside, as texts that no spreadsheet takes for a formula."""
    safe = lambda c: F.when(F.col(c).cast("string").rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), F.col(c).cast("string"))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return newest(logs, n, at, key=key).select(*[safe(c).alias(c) for c in fields])


def hourly_series(calls: DataFrame, at: str, now: Column, hours: int, *sums: str) -> DataFrame:
    """``hour, calls, *sums`` of each of the last ``hours`` hours, those without a call included."""
    end = F.date_trunc("hour", now)
    one = calls.sparkSession.range(1)
    every = one.select(F.explode(F.sequence(end - F.expr(f"INTERVAL {hours - 1} HOURS"), end, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    near = calls.withColumn("hour", F.date_trunc("hour", F.col(at).cast("timestamp"))).groupBy("hour").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in sums])
    return every.join(near, "hour", "left").select("hour", F.coalesce("calls", F.lit(0)).alias("calls"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])
