"""A caller's metric on arrays gives the pairs that it gives on columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import pairwise as P
from weft.plans.vectors import manhattan


def by_columns(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


@pytest.mark.parametrize("limit", [None, 2.5])
def test_arrays_and_columns_agree(spark, limit):
    draw = np.random.default_rng(5)
    rows = [(k % 37, draw.random(6).tolist() if k % 9 else None) for k in range(40)]  # keys come twice, some vectors are missing
    items = spark.createDataFrame(rows, "k int, v array<double>")
    want = P.pairwise_custom(items, "k", "v", by_columns, limit, 10)
    got = P.pairwise_custom(items, "k", "v", manhattan, limit, 10, arrays=True)
    plain = lambda df: sorted((r["i"], r["j"], -1.0 if r["dist"] is None else round(r["dist"], 9)) for r in df.collect())
    assert plain(got) == plain(want) and got.count() > 5
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
