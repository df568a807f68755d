"""Retrieval quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(predictions: DataFrame, truth: DataFrame, k: int = 5, strategies: Sequence[str] | None = None) -> DataFrame:
    """``strategy, query_id, recall, mrr, ndcg`` of ``strategy, query_id, rank, id`` against ``query_id, ids``.

    A query without truth has the ideal of one hit that never comes: all three are 0. The reciprocal rank looks
    at the whole list, the others at its first ``k``. Every strategy has a row for every query of ``truth``, all 0 where
    it found nothing; ``strategies`` names them, by default those that occur in ``predictions``.
    """
    wanted = truth.select("query_id", F.array_distinct(F.coalesce("ids", F.array().cast("array<string>"))).alias("ids"))
    names = [r.strategy for r in predictions.select("strategy").distinct().collect()] if strategies is None else strategies  # a few names
    asked = wanted.withColumn("strategy", F.explode(F.array(*map(F.lit, names)).cast("array<string>")))
    marked = asked.join(predictions, ["strategy", "query_id"], "left").withColumn("hit", F.coalesce(F.array_contains("ids", F.col("id")), F.lit(False)))
    near = F.col("hit") & (F.col("rank") <= k)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size("ids"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    grouped = marked.groupBy("strategy", "query_id").agg(
        F.count_if(near).alias("found"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("gain"), F.first("ids").alias("ids")
    )
    return grouped.select(
        "strategy",
        "query_id",
        F.round(F.col("found") / F.greatest(F.size("ids"), F.lit(1)), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.col("gain") / ideal, 6).alias("ndcg"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means per strategy."""
    return metrics.groupBy("strategy").agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in ("recall", "mrr", "ndcg")])
