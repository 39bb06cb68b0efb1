"""Joins by cells against brute force: same rows, and few enough pairs measured."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import cells, vectors


def table(spark, v, ids=None):
    rows = [(int(i), None if x is None else [float(e) for e in x], 7, "v") for i, x in zip(ids if ids is not None else range(len(v)), v, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, dist string")


def brute_knn(q, v, k, metric, q_ids, ids):
    d = vectors.measured(q, np.broadcast_to(v, (len(q), *v.shape)), metric)
    return {int(i): [(int(ids[j]), r + 1) for r, j in enumerate(np.lexsort((ids, row))[:k])] for i, row in zip(q_ids, d, strict=True)}


def clustered(rng, n, dim, centres, spread):
    return rng.normal(size=(centres, dim))[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("shape", ["clustered", "one point", "far away", "line", "zeros"])
def test_knn_cells(spark, monkeypatch, metric, shape):
    """Small blocks and cells; a third of all rows at one point; points far from the origin; equal distances; zeros."""
    monkeypatch.setattr(cells, "STREAM", 40)
    monkeypatch.setattr(cells, "VISITORS", 15)
    rng = np.random.default_rng(1)
    v = clustered(rng, 240, 5, 9, 0.1)
    if shape == "one point":
        v[::3] = v[0]
    if shape == "far away":
        v = v + 1e5
    if shape == "line":
        v = np.arange(240)[:, None] % 50 * np.ones((1, 2))
    if shape == "zeros":
        v[::4] = 0
    v, ids = np.round(v, 6), rng.permutation(240)
    q, q_ids = np.vstack((v[:50], v[:10] + 0.5, 30 * v[5:6])), np.arange(1000, 1061)
    df = table(spark, [*v, None], [*ids, 999])
    want = brute_knn(q, v, 7, metric, q_ids, ids)
    got = {}
    for r in cells.knn_cells(df, table(spark, [*q, None], [*q_ids, 5]), 7, metric=metric, n_cells=12).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert {i: [(j, r) for r, j in sorted(x)] for i, x in got.items()} == want


def test_knn_cells_edges(spark):
    df = table(spark, np.arange(6.0)[:, None])
    assert cells.knn_cells(df, df, 50).count() == 36
    assert cells.knn_cells(df.limit(0), df, 3).count() == 0 and cells.knn_cells(df, df.limit(0), 3).count() == 0


def test_knn_cells_measures_few(spark):
    rng = np.random.default_rng(2)
    df, n = table(spark, clustered(rng, 3000, 8, 60, 0.05)), []
    assert cells.knn_cells(df, df, 5, measured=n).count() == 15_000
    assert n[0] < 3000 * 3000 / 10


def test_knn_join_of_many_queries(spark, monkeypatch):
    """The broadcast and the join by cells agree."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = vectors.knn_join(df, df, 5).select("query_id", "rank", "id").collect()
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 100)
    got = vectors.knn_join(df, df, 5).select("query_id", "rank", "id").collect()
    assert sorted(got) == sorted(want) and len(got) == 2500


def brute_pairs(v, ids, threshold, metric):
    s = vectors.similarities(v, v, metric)
    return sorted((min(int(ids[a]), int(ids[b])), max(int(ids[a]), int(ids[b]))) for a in range(len(v)) for b in range(a + 1, len(v)) if s[a, b] >= threshold)


@pytest.mark.parametrize(("metric", "threshold"), [("cosine", 0.9), ("cosine", 0.2), ("cosine", -0.5), ("l2", 0.6)])
@pytest.mark.parametrize("copies", [False, True])
def test_similar_classes(spark, monkeypatch, metric, threshold, copies):
    monkeypatch.setattr(cells, "STREAM", 30)
    monkeypatch.setattr(cells, "VISITORS", 30)
    rng = np.random.default_rng(3)
    v = np.round(clustered(rng, 150, 4, 8, 0.2), 6)
    v[5] = 0
    if copies:
        v[::3], v[1::40] = v[0], 0
    ids = rng.permutation(150)
    df = table(spark, [*v, None], [*ids, 777])
    pairs, members = cells.similar_classes(df, threshold, metric=metric, n_cells=9)
    want = brute_pairs(v, ids, threshold, metric)
    assert sorted(tuple(r) for r in cells.expanded(pairs, members, metric).select("i", "j").collect()) == want
    links = dict.fromkeys(map(int, ids), 0)
    for a, b in want:
        links[a] += 1
        links[b] += 1
    assert {r["id"]: r["n_links"] for r in cells.link_counts(df, threshold, metric=metric, n_cells=9).collect()} == links
    assert pairs.count() <= len({tuple(x) for x in v}) ** 2 / 2


def test_similar_classes_measure_few(spark):
    rng = np.random.default_rng(4)
    v, n = clustered(rng, 4000, 16, 80, 0.05), []
    pairs, _ = cells.similar_classes(table(spark, v), 0.9, measured=n)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert pairs.count() == ((unit @ unit.T >= 0.9).sum() - 4000) // 2
    assert n[0] < 4000 * 4000 / 2 / 10, n


def test_similar_classes_edges(spark):
    df = table(spark, np.ones((3, 2)))
    pairs, members = cells.similar_classes(df, 0.5)
    assert pairs.count() == 0 and members.where(F.col("rep") == 0).count() == 3
    assert cells.similar_classes(df.limit(0), 0.5)[0].count() == 0
