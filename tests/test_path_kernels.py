"""Distances of paths by products of whole blocks, against one pair at a time."""

import itertools

import numpy as np
import pytest

from weft.functions import kernels as K
from weft.operators import pairwise as P


def paths(n, seed, courses="abcdefgh", ends_first=False):
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        held = sorted(draw.choice(list(courses), draw.integers(0, len(courses) + 1), replace=False).tolist())
        pos = draw.integers(0, 4, len(held)).tolist()
        out.append((held, pos, int(draw.integers(0, 4)) if ends_first else max(pos, default=-1) + 1))
    return out


def block(rows):
    held = lambda k: np.array([r[k] for r in rows] + [None], dtype=object)[:-1]
    return {"courses": held(0), "pos": held(1), "n_sem": np.array([r[2] for r in rows], dtype=np.int64)}


def one(a, b, improved):
    """Differing course pairs of the union (or their share) of two paths."""
    at, bt = dict(zip(*a[:2])), dict(zip(*b[:2]))
    differ = pairs = 0
    for x, y in itertools.combinations(sorted({*at, *bt}), 2):
        sa, sb = (np.sign(t.get(x, p[2]) - t.get(y, p[2])) for t, p in ((at, a), (bt, b)))
        if improved:
            sa, sb = sa if x in at and y in at else 0, sb if x in bt and y in bt else 1
        pairs, differ = pairs + 1, differ + (sa != sb)
    return differ if not improved else differ / pairs if pairs else np.nan


def gaps(a, b):
    union = {*a[0], *b[0]}
    places = [[dict(zip(*p[:2])).get(c, p[2]) for c in union] for p in (a, b)]
    top = max([*places[0], *places[1], a[2], b[2]], default=0) + 1
    return np.array([(sum(x <= t for x in places[0]) - sum(x <= t for x in places[1])) / max(1, len(union)) for t in range(top)])


@pytest.mark.parametrize("ends_first", [False, True])
@pytest.mark.parametrize("cells", [8_000_000, 100])
def test_kernels_equal_the_slow_way(ends_first, cells):
    """Also where the blocks use different courses, a path is empty, or courses stand at or behind a path's end."""
    left, right = paths(25, 1, ends_first=ends_first) + [([], [], 0)], paths(30, 2, "efghijkl", ends_first) + [([], [], 0), ([], [], 2)]
    a, b = block(left), block(right)
    want = lambda fn: np.array([[fn(x, y) for y in right] for x in left], float)
    assert (K.path_order(a, b, cells) == want(lambda x, y: one(x, y, False))).all()
    first, second = K.path_order_share_both(a, b, cells)
    np.testing.assert_allclose(first, want(lambda x, y: one(x, y, True)), rtol=1e-15)
    np.testing.assert_allclose(second, want(lambda x, y: one(y, x, True)), rtol=1e-15)
    np.testing.assert_allclose(K.path_energy(a, b), want(lambda x, y: np.sqrt(2 * (gaps(x, y) ** 2).sum())), rtol=1e-12, atol=1e-15)
    np.testing.assert_allclose(K.path_emd(a, b), want(lambda x, y: np.abs(gaps(x, y)).sum()), rtol=1e-12, atol=1e-15)


@pytest.mark.parametrize("name, most", [("order", 3), ("order_share", 5), ("path_energy", 1)])
def test_few_products_per_block_pair(monkeypatch, name, most):
    """One chunk of course pairs: the number of block products does not depend on the orders told apart, nor on who is read first."""
    seen = []
    plain = K.products
    monkeypatch.setattr(K, "products", lambda x, y: seen.append(x.shape) or plain(x, y), raising=True)
    (K.BOTH.get(name) or K.KERNELS[name])(block(paths(20, 3)), block(paths(20, 4)))
    assert 0 < len(seen) <= most


def test_lists_are_read_once_per_tile(spark, monkeypatch):
    """The tiles of a block meet many others; their course lists are laid out once."""
    rows = [(i, *p) for i, p in enumerate(paths(60, 5))]
    df = spark.createDataFrame(rows, "id long, courses array<string>, pos array<int>, n_sem int")
    got = {(r["i"], r["j"]): r["dist"] for r in P.pairwise(df, "id", "order_share", block_rows=7).collect()}
    assert len(got) == 60 * 59 // 2
    for (i, j), dist in got.items():
        want = one(rows[i][1:], rows[j][1:], True)
        assert dist is None and np.isnan(want) or dist == pytest.approx(want)
    side = block(paths(5, 6))
    side["grid"] = K.path_grid(side)
    side["courses"] = side["pos"] = None  # not read again
    assert K.path_order(side, side).shape == (5, 5)
