"""Clustering features: exact totals, bounded radii, the same clusters for any partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import birch as B
from weft.operators import evaluate as E


def blobs(n, dim=4, k=5, spread=0.4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, dim)) * 8
    own = rng.integers(0, k, n)
    return centres[own] + rng.normal(size=(n, dim)) * spread, own


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_features_add_up_and_keep_the_radius(spark, parts):
    x = np.round(blobs(2000)[0] * 16)  # whole numbers add up exactly
    got = B.features(frame(spark, x).repartition(parts), "v", 10.0, leaves=60).collect()
    n, total, squares = np.array([r["n"] for r in got]), np.array([r["total"] for r in got]), np.array([r["squares"] for r in got])
    assert len(got) <= 60 and n.sum() == len(x)
    assert (total.sum(axis=0) == x.sum(axis=0)).all() and squares.sum() == (x**2).sum()
    limit = max(r["threshold"] for r in got)
    assert limit >= 10.0 and (B.radius(n, total, squares) <= limit * (1 + 1e-9)).all()


def test_a_full_tree_raises_its_threshold():
    rng = np.random.default_rng(3)
    tree = B.Tree(2, 0.0, leaves=30, branches=5)
    x = rng.normal(size=(500, 2))
    for v in x:
        tree.insert(1.0, v, float(v @ v))
    n, total, squares = (np.array(c) for c in zip(*tree.entries()))
    assert len(n) == tree.count <= 30 and n.sum() == 500 and tree.threshold > 0
    assert np.allclose(total.sum(axis=0), x.sum(axis=0)) and (B.radius(n, total, squares) <= tree.threshold * (1 + 1e-6)).all()

    def check(node):
        for i, child in enumerate(node.children or []):
            s = child.sums()
            assert np.isclose(node.n[i], s[0]) and np.allclose(node.total[i], s[1]) and child.size <= 5
            check(child)

    check(tree.root)


def test_partitions_do_not_matter(spark):
    x, own = blobs(1500)
    df = frame(spark, x)
    truth = spark.createDataFrame([(i, int(k)) for i, k in enumerate(own)], "id long, own int")
    for parts in (1, 2, 17):
        got = B.birch_bins(df.repartition(parts), "id", "v", 5, leaves=100)
        rand = E.adjusted_rand(got.join(truth, "id"), "cluster", "own").first()[0]
        assert rand > 0.98, parts


def test_ward_is_the_cheapest_merge():
    rng = np.random.default_rng(6)
    n, c = rng.integers(1, 5, 40).astype(float), rng.normal(size=(40, 3))
    groups = [[i] for i in range(40)]
    while len(groups) > 6:
        def cost(a, b):
            na, nb = n[a].sum(), n[b].sum()
            gap = (n[a] @ c[a]) / na - (n[b] @ c[b]) / nb
            return na * nb / (na + nb) * gap @ gap
        _, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    got = B.ward(n, c, 6)
    assert sorted(sorted(g) for g in groups) == sorted(np.flatnonzero(got == k).tolist() for k in range(6))
    assert B.ward(n[:3], c[:3], 6).tolist() == [0, 1, 2] and B.ward(n[:0], c[:0], 6).tolist() == []


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (None, [9.0, 9.0])], "id long, v array<double>")
    got = sorted(((r["id"], r["cluster"]) for r in B.birch_bins(df, "id", "v", 2).collect()), key=str)
    assert got == [(1, 0), (1, 0), (2, None), (3, None), (None, 1)]
    assert B.birch_bins(df.limit(0), "id", "v", 2).collect() == []
    assert B.birch_bins(df.filter(F.col("v").isNull()), "id", "v", 2).first()["cluster"] is None


def test_even_vectors_stay_apart(spark):
    """Vectors that are all about as far from each other must not fall into one entry when the tree is full."""
    x = np.random.default_rng(9).normal(size=(1500, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = B.birch_bins(frame(spark, x).coalesce(1), "id", "v", 10, leaves=500).groupBy("cluster").count().collect()
    assert len(got) == 10 and max(r["count"] for r in got) < 0.9 * len(x)
