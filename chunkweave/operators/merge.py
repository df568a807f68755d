"""Upserts, deltas and drafts as joins: new table contents from old contents and changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` replace rows of equal key, column by column where they are not null; others are added.

    ``changes`` must hold each key once (see :func:`latest`).
    """
    others = [c for c in current.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in others if c in changes.columns])
    joined = current.join(new, list(keys), "full_outer")
    return joined.select(*keys, *[F.coalesce(f"__n_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in others])


def latest(changes: DataFrame, keys: Sequence[str], at: str, order: str) -> DataFrame:
    """The last change of each key by time, then by ``order``; aggregated before the shuffle."""
    others = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(at, order)).alias("r"))
    return last.select(*keys, "r.*")


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the least by ``order``, then by all other columns, so that the choice never depends on partitions."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    sortable = [c for c in others if not isinstance(rows.schema[c].dataType, (MapType, VariantType))]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate([*order, *sortable])])).alias("__r"))
    return first.select(*keys, *[F.col("__r").getField(c).alias(c) for c in others]).select(*rows.columns)


def insert_missing(current: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is not there yet: what an insert that ignores conflicts would add. The first by ``order`` of a key wins."""
    return first_of(rows, keys, order).join(current.select(*keys), list(keys), "left_anti")


def soft_delete(current: DataFrame, seen: DataFrame, keys: Sequence[str], flag: str = "active") -> DataFrame:
    """Rows that a full snapshot no longer holds become inactive."""
    marked = seen.select(*keys).distinct().withColumn("__seen", F.lit(True))
    joined = current.join(marked, list(keys), "left")
    return joined.withColumn(flag, F.coalesce("__seen", F.lit(False)) & F.col(flag)).drop("__seen")


def cascade_delete(documents: DataFrame, gone: DataFrame, dependants: dict[str, tuple[DataFrame, Column | str]]) -> dict[str, DataFrame]:
    """Every table without the rows that belong to the documents ``gone.id``; ``dependants``: name -> (table, document column)."""
    ids = gone.select(F.col("id").alias("__gone")).distinct()
    out = {"documents": documents.join(ids, documents["id"] == ids["__gone"], "left_anti")}
    for name, (df, column) in dependants.items():
        on = df[column] if isinstance(column, str) else column
        out[name] = df.join(ids, on == ids["__gone"], "left_anti")
    return out


def merge_drafts(drafts: DataFrame, group: Sequence[str], order: str, text: str, related: str) -> DataFrame:
    """Drafts of a group as one: non-blank texts in order, joined by blank lines, and their related ids once, in order.

    Groups are what a person merges by hand; ``related`` is an array column.
    """
    listed = drafts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t"), F.col(related).alias("r")))).alias("rows"))
    texts = F.filter(F.transform("rows", lambda x: F.trim(F.coalesce(x["t"], F.lit("")))), lambda x: x != "")
    ids = F.array_distinct(F.flatten(F.transform("rows", lambda x: F.coalesce(x["r"], F.array().cast("array<string>")))))
    return listed.select(*group, F.array_join(texts, "\n\n").alias("content"), ids.alias("related_ids"), F.size("rows").alias("drafts"))


def version_log(settings: DataFrame, key: str, value: str, at: str, order: str) -> DataFrame:
    """Each setting's changes numbered, with the value before."""
    w = Window.partitionBy(key).orderBy(at, order)
    changed = settings.withColumn("before", F.lag(value).over(w)).filter(~F.col("before").eqNullSafe(F.col(value)) | F.col("before").isNull())
    return changed.withColumn("version", F.row_number().over(w))


def rolled_back(log: DataFrame, targets: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, version``: each setting as of the version that ``targets`` (``key, version``) asks for, else its last.

    ``log``: see :func:`version_log`. A version that a setting never had leaves its last.
    """
    rows = log.join(targets.select(key, F.col("version").alias("__wanted")), key, "left")
    order = F.struct((F.col("version") == F.coalesce("__wanted", F.lit(-1))).alias("asked"), "version")
    return rows.groupBy(key).agg(F.max_by(F.struct(value, "version"), order).alias("r")).select(key, F.col("r").getField(value).alias(value), "r.version")


def changes_since(rows: DataFrame, at: str, mark) -> DataFrame:
    """The rows later than the high watermark ``mark``; all of them where it is None. The filter reaches the scan."""
    return rows if mark is None else rows.filter(F.col(at) > F.lit(mark))
