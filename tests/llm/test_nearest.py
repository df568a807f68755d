import numpy as np
import pytest

from chunkweave.llm.nearest import _centred, _visited, fit_centroids, nearest_vectors
from chunkweave.llm.pruned_graph import PrunedGraph


def clusters(n, d, per, spread, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // per, d))
    x = np.repeat(centre, per, axis=0) + spread * rng.normal(size=(n // per * per, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_graph_recall():
    x = clusters(3000, 32, 12, 0.3, 2)
    graph = PrunedGraph(x, 16, 24)
    assert (graph.edges < len(x)).all() and (graph.edges != np.arange(len(x))[:, None]).all()
    ids, _ = graph.search(x, 24)
    sims = x @ x.T
    np.fill_diagonal(sims, -1)
    truth = np.argsort(-sims, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, truth)]) > 0.95


def brute(rows, least, k=10):
    names = sorted(rows)
    x = np.stack([rows[n] for n in names]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    pairs = set()
    for i, a in enumerate(names):
        order = sorted((j for j in range(len(names)) if j != i), key=lambda j: (-round(sims[i, j], 6), names[j]))[:k]
        pairs |= {(a, names[j]) for j in order if sims[i, j] >= least}
    return pairs


def test_neighbours_with_dirty_rows(spark):
    x = clusters(360, 64, 9, 0.05, 3) * 3
    rows = {f"c{k:04d}": v for k, v in enumerate(x)}
    rows |= {f"d{k:04d}": x[0] for k in range(40)}  # a hot group of equal vectors
    data = [(i, [float(z) for z in v], k, "n") for k, (i, v) in enumerate(rows.items())]
    data += [data[5], ("c0007", [1.0] * 64, 9000, "later"), (None, [1.0] * 64, 1, ""), ("z1", None, 1, ""), ("z2", [0.0] * 64, 1, ""), ("z3", [float("nan")] * 64, 1, ""), ("z4", [1.0] * 63, 1, ""), ("z5", [None] + [1.0] * 63, 1, "")]
    df = spark.createDataFrame(data, "chunk_id string, vec array<float>, at int, nid string")
    got = {(r.id, r.other_id) for r in nearest_vectors(df, "chunk_id", "vec", ["at"], least=0.85).collect()}
    want = brute(rows, 0.85)
    assert len(got & want) / len(want) > 0.97 and len(got - want) / len(got) < 0.03
    hot = {p for p in want if p[0].startswith("d")}
    assert hot <= got
    asked = spark.createDataFrame([("c0000",), ("d0003",)], "id string")
    few = {(r.id, r.other_id) for r in nearest_vectors(df, "chunk_id", "vec", ["at"], least=0.85, margin=None, visits=None, queries=asked).collect()}
    assert few == {p for p in want if p[0] in ("c0000", "d0003")}
    assert nearest_vectors(df.limit(0), "chunk_id", "vec", ["at"]).count() == 0


@pytest.mark.parametrize("shared", [0.0, 0.5, 0.8])
def test_visits_are_bounded_under_a_shared_direction(shared):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.sqrt(1 - shared)
    x[:, 0] += np.sqrt(shared)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    middle = x.mean(axis=0)
    y = _centred(x, middle)
    near = _visited(y, fit_centroids(y, 200), 0.15, None)[1]
    assert near.sum(axis=1).mean() < 16
    assert _visited(y, fit_centroids(y, 200), 0.15, 8)[1].sum(axis=1).max() <= 8


def test_visitors_in_blocks(spark, monkeypatch):
    """Shards split by hash, with their visitors in several blocks, give the same pairs."""
    from chunkweave.llm import nearest

    x = clusters(600, 64, 12, 0.05, 9)
    rows = {f"c{k:04d}": v for k, v in enumerate(x)}
    df = spark.createDataFrame([(i, [float(z) for z in v], k) for k, (i, v) in enumerate(rows.items())], "chunk_id string, vec array<float>, at int")
    monkeypatch.setattr(nearest, "SHARD_ROWS", 60)
    monkeypatch.setattr(nearest, "MOST_CELLS", 4)
    monkeypatch.setattr(nearest, "VISITORS", 100)
    got = {(r.id, r.other_id) for r in nearest_vectors(df, "chunk_id", "vec", ["at"], least=0.85).collect()}
    want = brute(rows, 0.85)
    assert len(got & want) / len(want) > 0.97 and len(got - want) / len(got) < 0.03


def test_brute_force(spark):
    from chunkweave.llm.queries_nearest import nearest_by_brute_force

    x = clusters(120, 8, 6, 0.4, 4)
    rows = {f"c{k:03d}": v for k, v in enumerate([*x, x[0], x[0]])}
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in rows.items()], "chunk_id string, vec array<float>")
    got = {(r.id, r.other_id) for r in nearest_by_brute_force(df, df).collect()}
    assert got == brute(rows, -2)
