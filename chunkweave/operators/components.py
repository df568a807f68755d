"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.runtime import drop_written, written


def _least(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over ``(u, v)``: link neighbours to the smallest node of the neighbourhood."""
    if small:
        linked = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        linked = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    least = linked.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = linked.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node that is the least of its own neighbourhood keeps no edge of its own; its neighbours do.
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of the edges ``(u, v)``; a component is named by its least node.

    Self-loops, repeated and reversed edges are harmless; edges with a null end are dropped; no edges give
    no rows. The stars are aggregated with map-side combine, so a node with very many neighbours
    costs no single task more than its joined rows, which AQE splits. Every step is a written table;
    only a count and a checksum reach the driver.
    """
    now = written(edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        following = written(_least(_least(now, False), True), "edges")
        row = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(now)
        now = following
        if mark == tuple(row):
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
