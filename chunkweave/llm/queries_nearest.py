"""Queries of problem 3."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkweave.llm.nearest import nearest_vectors, valid_vector
from chunkweave.runtime import table, written


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, vec, created_at, run_id, pos``: one row per vector of a run."""
    runs = table(spark, sf_dir, "embedding_run").select("run_id", "created_at", F.posexplode(F.arrays_zip("chunk_ids", "embeddings")).alias("pos", "e"))
    return runs.select(F.col("e.chunk_ids").alias("chunk_id"), F.col("e.embeddings").alias("vec"), "created_at", "run_id", "pos")


_ORDER = ["created_at", "run_id", "pos"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest_vectors(chunk_vectors(spark, sf_dir), "chunk_id", "vec", _ORDER, least=0.85)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


def _asked(vectors: DataFrame) -> DataFrame:
    """The query set of searches: the chunks of runs whose id is divisible by 20."""
    return vectors.filter((F.col("run_id") % 20 == 0) & F.col("chunk_id").isNotNull() & valid_vector("vec", 64)).select(F.col("chunk_id").alias("id")).distinct()


def _all_shards(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    return nearest_vectors(vectors, "chunk_id", "vec", _ORDER, margin=None, visits=None, queries=asked, degree=24, beam=32, reach=32)


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of each asked chunk among all chunks, every shard searched."""
    vectors = chunk_vectors(spark, sf_dir)
    return _all_shards(vectors, _asked(vectors)).select("id", "other_id", F.round(F.col("sim").cast("double"), 4).alias("sim"))


def _ten(vectors: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    return nearest_vectors(vectors, "chunk_id", "vec", _ORDER, margin=0.35, visits=32, queries=queries, degree=24, beam=32, reach=32)


def p3_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every chunk, however dissimilar, in a bounded number of shards."""
    return _ten(chunk_vectors(spark, sf_dir)).select("id", "other_id", F.round(F.col("sim").cast("double"), 4).alias("sim"))


#: Vectors of a part of the rows, and of a block of queries, that one task of the brute force compares.
_PART, _BLOCK = 16_384, 4_096


def nearest_by_brute_force(valid: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``id, other_id, sim``: the exact ``k`` nearest of ``queries`` (``chunk_id, vec``) among ``valid``; only for measuring."""
    parts = max(1, -(-valid.count() // _PART))
    blocks = max(1, -(-queries.count() // _BLOCK))
    at = lambda n, salt: F.pmod(F.xxhash64("chunk_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("chunk_id", "vec", at(blocks, 1).alias("block"), F.lit(True).alias("asks")).withColumn("part", every(parts))
    right = valid.select("chunk_id", "vec", at(parts, 2).alias("part"), F.lit(False).alias("asks")).withColumn("block", every(blocks))

    def brute(pdf: pd.DataFrame) -> pd.DataFrame:
        unit = np.stack(pdf["vec"].to_list()).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        asks = pdf["asks"].to_numpy()
        name = pdf["chunk_id"].to_numpy()
        q, n = np.flatnonzero(asks), np.flatnonzero(~asks)
        rows = []
        for begin in range(0, len(q), 256):
            own = q[begin : begin + 256]
            sims = unit[own] @ unit[n].T
            sims[name[own][:, None] == name[n][None, :]] = -2
            few = np.argpartition(-sims, min(k, len(n) - 1), axis=1)[:, : k + 1] if len(n) else np.zeros((len(own), 0), int)
            least = np.take_along_axis(sims, few, 1).min(axis=1) if len(n) > k else np.full(len(own), -1.5)
            for r, c in zip(own, range(len(own))):
                near = np.flatnonzero((sims[c] >= least[c]) & (sims[c] > -1.5))  # with all ties of the last one
                for b in near[np.lexsort((name[n[near]], -sims[c, near]))[:k]]:
                    rows.append((name[r], name[n[b]], sims[c, b]))
        return pd.DataFrame(rows, columns=["id", "other_id", "sim"])

    best = left.unionByName(right).groupBy("part", "block").applyInPandas(brute, "id string, other_id string, sim double")
    order = Window.partitionBy("id").orderBy(F.desc("sim"), "other_id")
    return best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def p3_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the asked chunks against brute force over all rows, by the very settings of each query.

    ``p3_found``: the ten nearest by its settings, and its own pairs among those of at least 0.85; ``p3_ten`` and
    ``p3_neighbours``: their ten nearest.
    """
    vectors = chunk_vectors(spark, sf_dir)
    valid = vectors.filter(F.col("chunk_id").isNotNull() & valid_vector("vec", 64)).groupBy("chunk_id").agg(F.min_by("vec", F.struct(*_ORDER)).alias("vec"))
    asked = written(_asked(vectors), "asked-chunks")
    queries = valid.join(asked.withColumnRenamed("id", "chunk_id"), "chunk_id", "left_semi")
    truth = written(nearest_by_brute_force(valid, queries), "nearest-truth")
    pair = [F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")]
    similar = truth.filter("sim >= 0.85").select(*pair).distinct()
    pairs = similar.join(p3_found(spark, sf_dir).withColumn("hit", F.lit(1)), ["id_a", "id_b"], "left")
    out = pairs.agg(F.lit("p3_found, its pairs").alias("measured"), F.count("*").alias("pairs"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    searches = {
        "p3_found, ten nearest": lambda: nearest_vectors(vectors, "chunk_id", "vec", _ORDER, queries=asked),
        "p3_ten": lambda: _ten(vectors, asked),
        "p3_neighbours": lambda: _all_shards(vectors, asked),
    }
    for name, search in searches.items():
        hits = search().select("id", "other_id", F.lit(1).alias("hit"))
        joined = truth.join(hits, ["id", "other_id"], "left")
        out = out.unionByName(joined.agg(F.lit(name).alias("measured"), F.count("*").alias("pairs"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall")))
    return out


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_ten": p3_ten, "p3_recall": p3_recall}
SQL: dict[str, str] = {}
