"""Pairs in tiles of larger blocks: what travels grows with the items, and every pair is met once."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from weft.functions import kernels as K
from weft.operators import pairwise as P


def rows(n, dim=6, seed=3):
    draw = np.random.default_rng(seed)
    return draw.normal(size=(n, dim)).round(3)


@pytest.mark.parametrize("bound", [None, "first"])
def test_copies_do_not_grow_with_the_number_of_tiles(spark, bound):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows(400))], "id long, v array<double>")
    first, reach = (F.get("v", F.lit(0)), 9.0) if bound else (None, None)
    left, right, _ = P.tagged_blocks(df, "id", 2, first, reach, P.LARGE)
    assert left.count() + right.count() <= 400 * (P.BLOCKS + 1) * (1 if bound is None else 2)


@pytest.mark.parametrize("bounded", [False, True])
def test_tiles_of_blocks_give_every_near_pair(spark, monkeypatch, bounded):
    monkeypatch.setattr(P, "BLOCKS", 3)
    monkeypatch.setattr(P, "FOLDED", 50)
    x = rows(120)
    x[:50, 0] = 1.5  # a range of one repeated value
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if d[i, j] <= 2.0}
    bound = (F.get("v", F.lit(0)), 2.0) if bounded else (None, None)
    got = P.radius_join(df, "id", "euclidean", 2.0, *bound, block_rows=7).collect()
    assert len(got) == len(want) and {(r["i"], r["j"]) for r in got} == want
    assert [r["dist"] for r in got] == pytest.approx([d[r["i"], r["j"]] for r in got])
    np.fill_diagonal(d, np.nan)
    stats = {r["item"]: r for r in P.distance_stats(df, "id", "euclidean", 7, radius=2.0).collect()}
    assert len(stats) == 120 and all(stats[i]["n"] == 119 and stats[i]["near"] == (d[i] <= 2.0).sum() for i in range(120))
    near = P.nearest(df, "id", "euclidean", 3, block_rows=7).collect()
    assert {(r["item"], r["neighbour"]) for r in near} == {(i, int(j)) for i in range(120) for j in np.argsort(d[i], kind="stable")[:3]}
    assert P.max_distance(df, "id", "euclidean", 7).first()["top"] == pytest.approx(np.nanmax(d))


@pytest.mark.parametrize("name, within", [("euclidean", 2.5), ("energy", 0.5), ("energy", 0.0), ("euclidean", 0.0)])
def test_bounded_kernels_keep_what_is_near(name, within):
    x, y = rows(40), rows(50, seed=4)
    y[:5] = x[:5]
    x[6, 2], y[7, 1], y[8, 0] = np.nan, np.inf, np.nan
    with np.errstate(invalid="ignore"):
        whole, got = K.KERNELS[name]({"v": x}, {"v": y}), K.WITHIN[name]({"v": x}, {"v": y}, within=within)
        near = whole <= within
        assert near.any() and (near == (got <= within)).all() and (whole[near] == got[near]).all()
    assert np.isinf(got).any()  # and not all pairs are worked out


def test_bits_by_products_equal_the_slow_way():
    x = (rows(30) > 0.4).astype(float)
    slow = np.array([[(p != q).sum() / max(1, ((p != 0) | (q != 0)).sum()) for q in x] for p in x])
    assert (K.jaccard_bits({"v": x}, {"v": x}) == slow).all()


@pytest.mark.parametrize("k", [1, 3, 60])
def test_nearest_by_products_leaves_few_open(k):
    x, y = rows(40), rows(50, seed=4)
    y[:5] = x[:5]
    y[20:25] = y[30]  # ties
    same = np.zeros((40, 50), bool)
    same[1, 1] = True
    d = np.where(same, np.inf, K.euclidean({"v": x}, {"v": y}))
    r, c, dist = K.euclidean_nearest(x, y, same, k)
    assert (dist == d[r, c]).all() and not same[r, c].any() and (k > 50 or len(r) < 40 * (k + 6))
    got = {(i, j) for i, j in zip(r.tolist(), c.tolist())}
    assert all((i, int(j)) in got for i in range(40) for j in np.argsort(d[i], kind="stable")[:k] if not same[i, j])


def test_weights_are_not_sorted_for_their_norms(spark):
    from weft.operators.vectors import count_vectors

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = count_vectors(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "d long, t string"), "d", "t")
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r["d"], r["t"]): round(r["w"], 6) for r in got.collect()} == {(1, "a"): 0.707107, (1, "b"): 0.707107, (2, "a"): 1.0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
