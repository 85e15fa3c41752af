import math

import numpy as np
import pytest

from weft.llm import eigen, whitening


def whole(vectors):
    return np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def reference(x, k):
    """deviation and whitened by plain float64 over the whole table."""
    n, s = len(x), x.sum(axis=0)
    gaps = n * x - s
    c = (gaps / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return [int(t) for t in (gaps**2).sum(axis=1)], (c @ vectors / np.sqrt(values))[:, :k], values[:k] / values.sum()


def check(got, x, k):
    deviation, want, explained = reference(x, k)
    assert len(got) == len(x) * k
    mine = np.zeros((len(x), k))
    for vec_id, component, n, dev, w, e, error in got:
        mine[vec_id, component - 1] = w
        assert n == len(x) and dev == deviation[vec_id] and error < 1e-10
        assert abs(e / explained[component - 1] - 1) < 1e-10
    assert np.abs(mine - want * np.sign((mine * want).sum(axis=0))).max() < 1e-8


def test_table_equals_numpy(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    raw = df.orderBy("vec_id").toPandas()
    number = {v: i for i, v in enumerate(raw.vec_id)}
    got = [(number[r[0]], *r[1:]) for r in whitening.whiten(df).collect()]
    check(got, whole(raw.embedding), 32)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitions_do_not_matter(spark, parts):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 5)).round(3) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, [float(np.float32(c)) for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    check(list(map(tuple, whitening.whiten(df.repartition(parts), components=3).collect())), whole(v), 3)


def test_edge_rows(spark):
    rng = np.random.default_rng(6)
    good = [(i, r.tolist(), "x") for i, r in enumerate(rng.normal(size=(40, 3)))]
    bad = [(100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [1.0, math.nan, 2.0], "x"), (103, [math.inf, 0.0, 0.0], "x"), (104, [], "x"), (105, [1.0, 2.0], "x"), (106, [1e30, 0.0, 0.0], "x")]
    schema = "vec_id long, embedding array<double>, component string"
    want = rows_of(whitening.whiten(spark.createDataFrame(good, schema)))
    assert rows_of(whitening.whiten(spark.createDataFrame(good + bad, schema))) == want
    repeated = whitening.whiten(spark.createDataFrame(good + good + [(None, [0.5, 0.5, 0.5], None)], schema)).collect()
    assert len(repeated) == 81 * 3 and {r["n"] for r in repeated} == {81} and sum(r["vec_id"] is None for r in repeated) == 3
    clash = spark.createDataFrame(good, "vec_id long, embedding array<double>, `a.b` string").withColumnRenamed("vec_id", "v")
    assert rows_of(whitening.whiten(clash, "v")) == want
    for rows in ([], bad, good[:1], good[:1] * 5):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(50, 2)) * [1e9, 1e-1]).round(2)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r] for r in v], object)
    want = (((50 * x - x.sum(axis=0)) ** 2).sum(axis=1)).tolist()
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    assert [got[i] for i in range(50)] == [t if t < 1 << 63 else None for t in want]


def test_sums_are_exact_in_any_size(spark):
    rows = spark.createDataFrame([(i, [2.0**50, -1.0]) for i in range(9)], "vec_id long, v array<double>").repartition(3)
    x = 2**56 + 1_000_000
    got = whitening.summed(rows, 2, lambda ids, x: whitening.gram(x).ravel())
    assert got == [9 * x * x, 9 * x * (1_000_000 - 64), 9 * x * (1_000_000 - 64), 9 * (1_000_000 - 64) ** 2]


SPECTRA = {
    "spread": np.linspace(1, 100, 48),
    "cluster": np.concatenate([np.linspace(1, 100, 44), [50 + 1e-9, 50, 50 - 1e-9, 50 + 3e-9]]),
    "wide": 10.0 ** np.linspace(-12, 2, 48),
    "equal": np.concatenate([np.full(20, 7.0), np.linspace(20, 30, 28)]),
    "one value": np.full(48, 3.0),
    "low rank": np.concatenate([np.zeros(40), np.linspace(1, 2, 8)]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenvectors(name):
    rng = np.random.default_rng(8)
    x = eigen.orthonormal(eigen.orthonormal(np.linalg.qr(rng.normal(size=(48, 48)))[0].astype(eigen.WIDE)))
    values = np.sort(SPECTRA[name])[::-1].astype(eigen.WIDE)
    a = eigen.product(x * values, x.T)
    a = (a + a.T) / 2
    w, v = eigen.eigenvectors(a)
    top = float(values[0])
    assert np.abs(eigen.product(v.T, v) - np.eye(48)).max() < 1e-17
    assert np.abs(eigen.product(a, v) - v * w).max() < 1e-15 * top and np.abs(w - values).max() < 1e-15 * top
    if name == "spread":
        assert np.minimum(np.abs(v - x).max(axis=0), np.abs(v + x).max(axis=0)).max() < 1e-16
    if name == "cluster":  # gaps of 1e-9: float64 alone is wrong by 1e-6 here
        assert np.minimum(np.abs(v - x).max(axis=0), np.abs(v + x).max(axis=0)).max() < 1e-8


def test_product_is_wider_than_float64():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(30, 50)).astype(eigen.WIDE), rng.normal(size=(50, 30)).astype(eigen.WIDE)
    exact = np.array([[sum(x * y for x, y in zip(r, c)) for c in b.T] for r in a])
    assert np.abs(eigen.product(a, b) - exact).max() < 1e-16
