import numpy as np
import pytest

from basalt.operators import nearest as nn
from basalt.operators import vectors as ve


def by_brute_force(chunks, queries, k):
    out = {}
    for q, v in queries.items():
        d = sorted((float(((np.array(x) - np.array(v)) ** 2).sum()), c) for c, x in chunks.items())
        out[q] = d[:k]
    return out


def frames(spark, chunks, queries):
    c = spark.createDataFrame([(k, f"s{k}", [float(x) for x in v]) for k, v in chunks.items()], "chunk_id string, source_document string, embedding array<double>").repartition(5)
    return c, spark.createDataFrame([(k, [float(x) for x in v]) for k, v in queries.items()], "query_id int, query_vector array<double>").repartition(3)


def compare(spark, chunks, queries, k, pivots=16):
    c, q = frames(spark, chunks, queries)
    hits, opened = nn.nearest(nn.build(c, ("source_document",), pivots), q, k)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        assert r.source_document == f"s{r.chunk_id}"
        got.setdefault(r.query_id, []).append((r.distance, r.chunk_id))
    for n, rows in by_brute_force(chunks, queries, k).items():
        assert [x for _, x in got.get(n, [])] == [x for _, x in rows], n
        assert np.allclose([d for d, _ in got.get(n, [])], [d for d, _ in rows], rtol=1e-12, atol=0)
    return {r.query_id: r.opened / r.n_pivots for r in opened.collect()}


def test_clusters_are_pruned_and_results_exact(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 30
    chunks = {f"c{k}": centres[k % 20] + rng.normal(size=8) for k in range(3000)}
    queries = {k: centres[k % 20] + rng.normal(size=8) for k in range(60)}
    share = compare(spark, chunks, queries, 5, pivots=20)
    assert len(share) == 60 and np.mean(list(share.values())) < 0.2


@pytest.mark.parametrize("k", [1, 7, 5000])
def test_any_vectors(spark, k):
    rng = np.random.default_rng(k)
    chunks = {f"c{n:04d}": np.round(rng.normal(size=3), 1) for n in range(800)}  # ties
    chunks |= {f"same{n:04d}": np.zeros(3) for n in range(300)} | {"far": np.full(3, 1e8)}
    compare(spark, chunks, {n: rng.normal(size=3) * 10.0 ** rng.integers(-3, 3) for n in range(40)} | {99: np.zeros(3)}, k)


def test_crowded_pivot_and_cases(spark, monkeypatch):
    monkeypatch.setattr(nn, "ROWS", 50)
    monkeypatch.setattr(nn, "ASKED", 10)
    rng = np.random.default_rng(3)
    chunks = {f"c{k}": np.append(rng.normal(size=2) * 0.01, 1) for k in range(900)} | {f"d{k}": rng.normal(size=3) * 50 for k in range(20)}
    compare(spark, chunks, {k: rng.normal(size=3) for k in range(45)}, 5, pivots=4)
    c, q = frames(spark, {"a": [1, 2], "b": [3, 4]}, {1: [1, 2]})
    bad = spark.createDataFrame([("n", "s", None), ("x", "s", [1.0, None]), ("y", "s", [float("nan"), 1.0]), ("z", "s", [1.0] * 3), ("e", "s", [])], c.schema)
    ask = spark.createDataFrame([(2, None), (3, [1.0]), (4, [float("inf"), 0.0]), (5, [])], q.schema)
    index = nn.build(c.union(bad.where("chunk_id <> 'z'")))
    hits, opened = nn.nearest(index, q.union(ask), 5)
    assert [(r.query_id, r.chunk_id, r.distance) for r in hits.orderBy("rank").collect()] == [(1, "a", 0.0), (1, "b", 8.0)] and opened.count() == 1
    for index, asked in ((nn.build(c.limit(0)), q), (index, q.limit(0))):
        assert nn.nearest(index, asked, 5)[0].count() == 0
    with pytest.raises(ValueError, match="top_k"):
        nn.nearest(index, q, 0)


def test_many_queries_meet_chunks_in_a_grid(spark):
    rng = np.random.default_rng(4)
    chunks, queries = {f"c{k}": rng.normal(size=4) for k in range(300)}, {k: rng.normal(size=4) for k in range(2500)}
    c, q = frames(spark, chunks, queries)
    got = {}
    for r in ve.top_k_many(c, q, 3, ("source_document",)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {n: [x for _, x in rows] for n, rows in by_brute_force(chunks, queries, 3).items()}


def test_vectors_far_from_the_origin(spark):
    rng = np.random.default_rng(5)
    offset = np.array([1e7, -3e7, 2e7])
    chunks = {f"c{k}": offset + np.round(rng.normal(size=3), 3) for k in range(500)}
    compare(spark, chunks, {k: offset + rng.normal(size=3) for k in range(20)}, 3, pivots=8)
