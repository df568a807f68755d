"""Problem 3: the most similar vectors for every vector, by robust-pruned graphs in shards.

Vectors are routed to shards by the nearest of a set of centroids, fitted on a bounded sample; every
vector is indexed in its own shard. In each shard one task builds a pruned graph and answers by beam search
the vectors that live there and those that visit from neighbouring shards. Routing looks at the vectors without
the mean of the sample, so a direction that all of them share doesn't make every shard a neighbour; the visitors
of a shard that very many would visit are split into blocks, each with its own copy of the graph. Equal vectors are
one node, so a vector repeated in a third of all rows costs one search, and its copies are ranked by id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkweave.llm.pruned_graph import PrunedGraph
from chunkweave.runtime import broadcast_if_small, spread, written

#: Vectors in a shard, about.
SHARD_ROWS = 4000
#: Vectors of the sample that centroids are fitted on: at least and at most about.
SAMPLE_ROWS, MOST_SAMPLE_ROWS = 20_000, 100_000
#: Most centroids; beyond (about 65 million vectors), shards of a centroid are split by hash and all of them are searched.
MOST_CELLS = 8192
#: Visitors searched by one task, about.
VISITORS = 8 * SHARD_ROWS
_SEARCH = 512


def valid_vector(vec: str, size: int):
    """``size`` numbers, none null, NaN or infinite, and not all zero."""
    top, low, endless = F.array_max(vec), F.array_min(vec), float("inf")  # NaN is the greatest of all
    numbers = (top < endless) & (low > -endless) & ((top != 0) | (low != 0))
    return F.col(vec).isNotNull() & (F.size(vec) == size) & F.coalesce(numbers, F.lit(False)) & ~F.exists(vec, lambda x: x.isNull())


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(7)
    centre = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[b : b + 4096] @ centre.T).argmax(axis=1) for b in range(0, len(sample), 4096)])
        order = np.argsort(own, kind="stable")
        heads, first = np.unique(own[order], return_index=True)
        total = np.zeros_like(centre)
        total[heads] = np.add.reduceat(sample[order], first, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), centre)
    return centre.astype(np.float32)


def _unit(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def numbered_vectors(vectors: DataFrame, key: str, vec: str, order: Sequence[str], size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, copies, nodes): ``mid, id`` in the order of ids; ``mid, nid`` of ids that share a vector; ``nid, vec``.

    Of the rows of a key the first by ``order`` counts; ``order`` must identify a row.
    """
    rows = vectors.filter(F.col(f"`{key}`").isNotNull() & valid_vector(vec, size))
    rows = rows.select(F.col(f"`{key}`").alias("id"), F.col(vec).alias("vec"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(order)])
    at = [f"__{k}" for k in range(len(order))]
    hashed = rows.select("id", F.struct(*at).alias("at"), F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    first = hashed.groupBy("id").agg(F.min("at").alias("at"), F.min_by(F.struct("h1", "h2"), "at").alias("h"))
    ids = written(first.select("id", "at", "h.h1", "h.h2").orderBy("id").withColumn("mid", F.monotonically_increasing_id()), "vector-ids")
    groups = written(ids.groupBy("h1", "h2").agg(F.min(F.struct("mid", "at")).alias("first"), F.count("*").alias("n")), "vector-groups")
    shared = groups.filter("n > 1").select("h1", "h2", F.col("first.mid").alias("nid"))
    copies = ids.join(broadcast_if_small(shared), ["h1", "h2"]).select("mid", "nid")
    chosen = groups.select(F.col("first.mid").alias("nid"), "h1", "h2", *[F.col(f"first.at.{c}").alias(c) for c in at])
    rows = rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.hash("vec"))
    nodes = rows.join(broadcast_if_small(chosen), ["h1", "h2", *at]).select("nid", "vec")
    return ids.select("mid", "id"), copies, nodes


def _centred(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Unit vectors of ``x - middle``; a vector at the middle keeps its direction."""
    y = x - middle
    norm = np.linalg.norm(y, axis=1, keepdims=True)
    return np.where(norm > 1e-6, y / np.maximum(norm, 1e-6), x).astype(np.float32)


def _visited(y: np.ndarray, centre: np.ndarray, within: float, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, matrix of the centroids within reach, the ``most`` nearest of them) of centred vectors."""
    sims = y @ centre.T
    least = sims.max(axis=1, keepdims=True) - within
    if most is not None and most < len(centre):
        least = np.maximum(least, -np.partition(-sims, most - 1, axis=1)[:, most - 1 : most])
    return sims.argmax(axis=1), sims >= least


def shard_neighbours(
    nodes: DataFrame, count: int, size: int, k: int, least: float, margin: float | None, visits: int | None = None, queries: DataFrame | None = None, degree: int = 16, beam: int = 24, reach: int = 16
) -> DataFrame:
    """``q, n, sim``: for every node (or those of ``queries.nid``) its best nodes of at least ``least`` in the shards searched.

    A node visits the shards whose centroid is at most ``margin`` farther (in cosine, without the mean) than its nearest
    (None: all), the ``visits`` nearest of them (None: all).
    """
    spark = nodes.sparkSession
    cells = min(MOST_CELLS, max(1, round(count / SHARD_ROWS)))
    step = max(1, count // min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, 12 * cells)))
    sample = nodes.filter(F.pmod(F.xxhash64("nid"), F.lit(step)) == 0).select("vec").toPandas()["vec"]  # a bounded sample
    points = np.array([np.asarray(v, np.float64) for v in sample]).reshape(-1, size)
    points = (points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)).astype(np.float32)
    cells = min(cells, max(1, len(points)))
    within = 3.0 if margin is None else margin
    middle, centre, share, guests = np.zeros(size, np.float32), np.zeros((1, size), np.float32), np.ones(1), np.zeros(1)
    if len(points):
        middle = points.mean(axis=0)
        points = _centred(points, middle)
        centre = fit_centroids(points, cells)
        own, seen = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for b in range(0, len(points), 4096):
            nearest, near = _visited(points[b : b + 4096], centre, within, visits)
            own += np.bincount(nearest, minlength=cells)
            seen += near.sum(axis=0)
        share, guests = own / len(points), (seen - own) / len(points)
    parts = np.maximum(1, np.ceil(share * count / (2 * SHARD_ROWS))).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(parts)))
    # Visitors of a part: those of its cell, and the cell's own that live in its other parts.
    asking = 1.0 if queries is None else min(1.0, queries.count() / max(1, count))
    blocks = np.maximum(1, np.ceil((guests + share * (parts > 1)) * count * asking / VISITORS)).astype(np.int64)
    shared = spark.sparkContext.broadcast((middle, centre, parts, base, blocks))
    asked = nodes.withColumn("asks", F.lit(True))
    if queries is not None:
        asked = nodes.join(broadcast_if_small(queries.select("nid").distinct().withColumn("asks", F.lit(True))), "nid", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    asked = spread(asked.select("nid", "vec", "asks"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, centre, parts, base, blocks = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 2048):
                batch = whole.slice(begin, 2048)
                x = _unit(batch.column(1), size)
                nid = batch.column(0).to_numpy()
                asks = batch.column(2).to_numpy(zero_copy_only=False)
                nearest, near = _visited(_centred(x, middle), centre, within, visits)
                spot = nid * np.int64(0x9E3779B1) >> np.int64(7)
                own = base[nearest] + spot % parts[nearest]
                shard, row, home, block = [own], [np.arange(len(x))], [np.ones(len(x), bool)], [np.zeros(len(x), np.int64)]
                for extra in range(1, int(blocks[nearest].max()) if len(x) else 0):
                    more = np.flatnonzero(extra < blocks[nearest])  # residents of every block
                    shard.append(own[more])
                    row.append(more)
                    home.append(np.ones(len(more), bool))
                    block.append(np.full(len(more), extra))
                at, cell = np.nonzero(near & asks[:, None])
                for extra in range(int(parts[cell].max()) if len(cell) else 0):
                    s = base[cell] + extra
                    go = (extra < parts[cell]) & (s != own[at])
                    shard.append(s[go])
                    row.append(at[go])
                    home.append(np.zeros(int(go.sum()), bool))
                    block.append((spot[at[go]] // 64) % blocks[cell[go]])
                shard, row, home, block = map(np.concatenate, (shard, row, home, block))
                # Visitors travel as 16-bit fixed point (error of a cosine below 1e-5), residents in full.
                scale = np.abs(x).max(axis=1)
                small = np.rint(x / scale[:, None] * 32767).astype(np.int16)
                data = [x[r].tobytes() if h else small[r].tobytes() for r, h in zip(row, home)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(nid[row]), pa.array(home), pa.array(asks[row] & (~home | (block == 0))), pa.array(data, pa.binary())],
                    ["shard", "block", "nid", "home", "asks", "data"],
                )

    def answer(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        nid = table.column("nid").to_numpy()
        # Exactly repeated rows of the input arrive as the same node twice.
        once = np.sort(np.unique(nid * 2 + home, return_index=True)[1])
        if len(once) < len(nid):
            table = table.take(once)
            home, nid = home[once], nid[once]
        asks = table.column("asks").to_numpy()
        data = table.column("data").to_pylist()
        residents = np.flatnonzero(home)
        out_q, out_n, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        if len(residents) and asks.any():
            x = np.frombuffer(b"".join(data[r] for r in residents), np.float32).reshape(len(residents), size)
            graph = PrunedGraph(x, degree, beam)
            names = nid[residents]
            visitors = np.flatnonzero(~home)
            v = np.frombuffer(b"".join(data[r] for r in visitors), np.int16).reshape(len(visitors), size).astype(np.float32)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
            inside = np.flatnonzero(asks[residents])
            jobs = [(x[inside[b : b + _SEARCH]], names[inside[b : b + _SEARCH]], inside[b : b + _SEARCH]) for b in range(0, len(inside), _SEARCH)]
            jobs += [(v[b : b + _SEARCH], nid[visitors[b : b + _SEARCH]], None) for b in range(0, len(visitors), _SEARCH)]
            for q, who, start in jobs:
                ids, sims = graph.search(q, max(reach, k + 2), start=start)
                ids, sims = ids[:, : k + 2], sims[:, : k + 2]
                row, col = np.nonzero((ids >= 0) & (sims >= least - 1e-5))
                n = names[ids[row, col]]
                ok = n != who[row]
                out_q.append(who[row][ok])
                out_n.append(n[ok])
                out_s.append(sims[row, col][ok])
        return pa.table({"q": np.concatenate(out_q), "n": np.concatenate(out_n), "sim": np.concatenate(out_s)})

    routed = asked.mapInArrow(route, "shard int, block int, nid bigint, home boolean, asks boolean, data binary")
    # More partitions than groups, so that few tasks get two of them; a group is bounded, whatever the collection.
    tasks = int(min(2 * int((parts * blocks).sum()), 10_000))
    return routed.repartition(tasks, "shard", "block").groupBy("shard", "block").applyInArrow(answer, "q bigint, n bigint, sim float")


def nearest_vectors(
    vectors: DataFrame,
    key: str,
    vec: str,
    order: Sequence[str],
    k: int = 10,
    size: int = 64,
    least: float = -1.0,
    margin: float | None = 0.15,
    visits: int | None = 16,
    queries: DataFrame | None = None,
    degree: int = 16,
    beam: int = 24,
    reach: int = 18,
) -> DataFrame:
    """``id, other_id, sim``: the ``k`` most similar other ids of every id, those of at least ``least``.

    Ties go to the smaller id. Rows with a null key and vectors that are null, of another size, all zero or
    hold nulls, NaN or infinities take no part; of the rows of one key the first by ``order`` counts; an
    empty input gives no rows; other columns are ignored. ``queries`` (column ``id``) restricts the ids
    asked about, always against all vectors. ``margin`` and ``visits`` bound the shards a vector visits (None: no bound);
    ``visits`` keeps the cost of a vector the same in any collection. The search is approximate: see the README for measured recall.
    """
    ids, copies, nodes = numbered_vectors(vectors, key, vec, order, size)
    copies = written(copies, "vector-copies")
    asked = None
    if queries is not None:
        wanted = queries.select(F.col("id")).distinct().join(ids, "id").select("mid")
        asked = written(wanted.join(copies, "mid", "left").select("mid", F.coalesce("nid", "mid").alias("nid")), "asked")
    nodes = written(nodes, "vector-nodes") if queries is not None else nodes
    count = ids.count()
    found = shard_neighbours(nodes, count, size, k, least, margin, visits, asked, degree, beam, reach)
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "n")
    ranked = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("q", "n", "sim")
    # Nodes of several ids: the first k + 1 ids of a node are enough for any list it appears in.
    first = Window.partitionBy("nid").orderBy("mid")
    few = broadcast_if_small(written(copies.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).select("nid", "mid"), "few"))
    listed = ranked.join(few.withColumnRenamed("nid", "n"), "n", "left").select("q", F.coalesce("mid", "n").alias("other"), "sim")
    itself = few.select(F.col("nid").alias("q"), F.col("mid").alias("other"), F.lit(1.0).cast("float").alias("sim"))
    if asked is not None:
        itself = itself.join(asked.select(F.col("nid").alias("q")).distinct(), "q", "left_semi")
    listed = listed.unionByName(itself)
    owners = copies.select(F.col("nid").alias("q"), "mid")
    own = listed.join(owners, "q", "left").select(F.coalesce("mid", "q").alias("mid"), "other", "sim").filter("mid != other")
    if asked is not None:
        own = own.join(asked.select("mid"), "mid", "left_semi")
    last = Window.partitionBy("mid").orderBy(F.desc("sim"), "other")
    top = own.withColumn("r", F.row_number().over(last)).filter((F.col("r") <= k) & (F.col("sim") >= least))
    names = ids.select("mid", "id")
    return (
        top.join(names, "mid")
        .join(names.select(F.col("mid").alias("other"), F.col("id").alias("other_id")), "other")
        .select("id", "other_id", "sim")
    )
