"""Density clusters against a plain hierarchy, and the helpers they are built from."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions.kernels import KERNELS
from weft.operators import density as D
from weft.operators.order import before


def plain(dist, min_size, min_samples):
    """HDBSCAN step by step: sorted edges, merge tree, clusters, stabilities. Label = lowest item, None for noise."""
    n = len(dist)
    d = np.round(dist, D.DIGITS)
    core = [np.sort(np.delete(d[i], i))[min(min_samples, n - 1) - 1] for i in range(n)]
    w = np.maximum(d, np.maximum.outer(core, core))
    comp, members, ident = list(range(n)), {i: [i] for i in range(n)}, dict.fromkeys(range(n))
    at, items, birth, kids, holds = {}, {}, {}, {}, {}
    e = 0
    for _, i, j in sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = comp[i], comp[j]
        if a == b:
            continue
        e, lam = e + 1, 1 / max(w[i, j], 10.0**-D.DIGITS)
        big = [x for x in (a, b) if len(members[x]) >= min_size]
        both = members[a] + members[b]
        if len(big) == 1:
            c, fell = ident[big[0]], members[b if big[0] == a else a]
        elif len(both) >= min_size:
            c, fell = e, both
            kids[c] = [ident[x] for x in big]
            birth.update({ident[x]: lam for x in big})
        else:
            c, fell = None, []
        if c is not None:
            at[c] = at.get(c, 0) + len(fell) * lam
            items[c] = items.get(c, 0) + len(fell)
            holds.setdefault(c, []).extend(fell)
        for x in members[b]:
            comp[x] = a
        members[a], ident[a] = both, c
    own = {c: round(at[c] - birth[c] * items[c], D.DIGITS) for c in birth}
    best, chosen = {}, set()
    for c in sorted(kids):
        below = sum(best[k] for k in kids[c])
        best[c] = max(own.get(c, 0.0), below)
        if c in own and own[c] >= round(below, D.DIGITS):
            chosen.add(c)
    label = [None] * n
    todo = [(c, None) for c in kids if c not in birth]
    while todo:
        c, up = todo.pop()
        up = up if up is not None else c if c in chosen else None
        if up is not None:
            for x in holds[c]:
                label[x] = up
        todo += [(k, up) for k in kids[c]]
    low = {}
    for x, c in enumerate(label):
        low.setdefault(c, x)
    return [None if c is None else low[c] for c in label]


def made(n, kind):
    rng = np.random.default_rng(n)
    if kind == "blobs":
        centres = rng.normal(size=(6, 3)) * 6
        return np.concatenate([centres[rng.integers(0, 6, n - 20)] + rng.normal(size=(n - 20, 3)) * rng.choice([0.3, 1.0], (n - 20, 1)), rng.normal(size=(20, 3)) * 8])
    if kind == "grid":  # many equal distances
        return rng.integers(0, 9, (n, 2)).astype(float)
    return np.cumsum(rng.random((n, 1)), axis=0)  # a line: long chains


@pytest.mark.parametrize("n, kind, size, samples", [(300, "blobs", 5, 5), (300, "grid", 5, 3), (90, "line", 2, 1)])
def test_equals_the_plain_hierarchy(spark, n, kind, size, samples):
    x = made(n, kind)
    dist = KERNELS["euclidean"]({"v": list(x)}, {"v": list(x)})
    want = plain(dist, size, samples)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in D.density_clusters(df, "id", "euclidean", size, samples, block_rows=70).collect()}
    assert [got[i] for i in range(n)] == want
    assert len(set(want)) > 2


def test_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.1]), (4, None)], "id long, v array<double>")
    few = D.density_clusters(df.filter("v IS NOT NULL"), "id", "cosine", 2).collect()
    assert sorted(tuple(r) for r in few) == [(1, None), (2, None), (3, None)]
    assert D.density_clusters(df.limit(0), "id", "cosine").collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "id long, v array<double>")
    assert {r["cluster"] for r in D.density_clusters(same, "id", "euclidean").collect()} == {None}
    with pytest.raises(ValueError):
        D.density_clusters(df, "id", min_size=1)


def test_forest_is_the_least():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 6):
        w = rng.integers(1, 4, (n, n)).astype(float)
        w = np.minimum(w, w.T)
        np.fill_diagonal(w, np.inf)
        pairs = list(itertools.combinations(range(n), 2))
        got = D.forest(w)
        trees = []
        for some in itertools.combinations(pairs, n - 1):
            reach = {0}
            for _ in range(n):
                reach |= {y for p in some for x, y in (p, p[::-1]) if x in reach}
            if len(reach) == n:
                trees.append(sorted((w[p], *p) for p in some))
        assert sorted((w[i, j], i, j) for i, j in got.tolist()) == min(trees)
    w[0, :] = w[:, 0] = np.inf  # an item without edges
    assert len(D.forest(w)) == n - 2 and 0 not in D.forest(w)


def test_before(spark):
    rows = [(k, i, float((i * 7) % 5)) for k in (1, 2) for i in range(400 if k == 1 else 5)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    got = before(df.repartition(5), ["k"], ["i"], {"s": "x"}, {"m": "x"}).collect()
    for r in got:
        ahead = [x for k, i, x in rows if k == r["k"] and i < r["i"]]
        assert r["s"] == sum(ahead) and r["m"] == (max(ahead) if ahead else None)
    assert len(got) == len(rows)
