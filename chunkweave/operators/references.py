"""References to records that do not exist (composite keys with partial nulls).

References are grouped by the null mask of their key columns. Each group is anti-joined on the columns
that are not null, so no join condition contains ``OR ... IS NULL`` and every join stays an equi-join.
The declared match semantics decide which masks are references at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "full", "partial")


def _condition(left: DataFrame, right: DataFrame, keys: Sequence[str], within: Column | None) -> Column:
    same = [left[k] == right[f"__t_{k}"] for k in keys]
    return reduce(lambda a, b: a & b, same if within is None else [*same, within])


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    match: str = "simple",
    ref_at: str | None = None,
    target_at: str | None = None,
    grace_hours: int = 48,
) -> DataFrame:
    """Rows of ``refs`` whose key has no counterpart in ``targets``; the columns of ``refs``.

    ``match``: *simple* - a key with any null is no reference; *full* - an all-null key is no reference
    and a partly null key is always an orphan; *partial* - a partly null key must match on its non-null
    columns, an all-null key is no reference. With ``ref_at`` and ``target_at`` a target only counts if it
    is not more than ``grace_hours`` later than the reference; an unknown time on either side counts as
    in time. Targets are never multiplied into the result, repeated references stay repeated, targets
    with null keys match nothing on those columns, and an empty ``targets`` makes every reference an
    orphan. All other columns of ``refs`` pass through untouched; those of ``targets`` are not read.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    timed = ref_at is not None and target_at is not None
    wanted = [F.col(f"`{k}`").alias(f"__t_{k}") for k in keys]
    if timed:
        wanted.append(F.col(f"`{target_at}`").alias("__t_at"))
    there = targets.select(*wanted)
    parts = []
    for mask in product((False, True), repeat=len(keys)):  # True: the column is null
        if all(mask) or (match == "simple" and any(mask)):
            continue
        group = refs.filter(
            reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNull() if null else F.col(f"`{k}`").isNotNull() for k, null in zip(keys, mask)])
        )
        if match == "full" and any(mask):
            parts.append(group)
            continue
        on = [k for k, null in zip(keys, mask) if not null]
        known = there.filter(reduce(lambda a, b: a & b, [F.col(f"__t_{k}").isNotNull() for k in on]))
        names = [f"__t_{k}" for k in on]
        if timed:  # only the earliest target of a key matters
            known = known.groupBy(*names).agg(
                F.min(F.coalesce("__t_at", F.lit("1900-01-01").cast("timestamp"))).alias("__t_at")
            )
        else:
            known = known.select(*names).distinct()
        within = None
        if timed:
            limit = group[ref_at] + F.expr(f"INTERVAL {grace_hours} HOURS")
            within = F.coalesce(known["__t_at"] <= limit, F.lit(True))
        parts.append(group.join(known, _condition(group, known, on, within), "left_anti"))
    if not parts:
        return refs.limit(0)
    return reduce(DataFrame.unionByName, parts)


def classify_orphans(orphans: DataFrame, targets: DataFrame, key: str, deleted: str) -> DataFrame:
    """Add ``reason`` to orphans of a single-column key: missing, deleted or late."""
    state = targets.groupBy(F.col(f"`{key}`").alias("__k")).agg(F.bool_and(F.col(f"`{deleted}`")).alias("__gone"))
    joined = orphans.join(state, orphans[key] == state["__k"], "left")
    reason = F.when(F.col("__k").isNull(), "missing").when(F.col("__gone"), "deleted").otherwise("late")
    return joined.withColumn("reason", reason).drop("__k", "__gone")


def orphan_report(orphans: DataFrame, table: str = "ref_table", period: str = "period") -> DataFrame:
    """Orphans per table, period and reason."""
    return orphans.groupBy(table, period, "reason").agg(
        F.count("*").alias("orphans"), F.countDistinct("target_id").alias("targets")
    )
