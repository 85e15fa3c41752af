"""Pairs by bands: every pair once, and no key of the join with more than two bands of rows."""

from itertools import combinations, combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from weft.operators import neighbours as N
from weft.operators.bands import band_pairs, banded
from weft.operators.cooccur import cooccur_group

ROWS = [("hot", i, i * 2) for i in range(300)] + [("few", i, i) for i in range(5)] + [("one", 7, 1)]


@pytest.mark.parametrize("band", [16, 4096])
def test_every_pair_once(spark, band):
    df = spark.createDataFrame(ROWS, "k string, x int, v int").repartition(4)
    for same, pairs in ((False, combinations), (True, combinations_with_replacement)):
        got = sorted(map(tuple, band_pairs(df, "k", "x", same, band).collect()))
        want = sorted((k, a[1], b[1], a[2], b[2]) for k in ("hot", "few", "one") for a, b in pairs([r for r in ROWS if r[0] == k], 2))
        assert got == want


def test_no_key_has_more_than_two_bands(spark):
    """One key in every row: the rows that meet under one key of the join stay about two bands."""
    df = spark.createDataFrame([("all", i) for i in range(5000)], "k string, x int")
    left, right = banded(df, "k", "x", 100)
    cells = left.select("_p", "_q").unionByName(right.select("_p", "_q")).groupBy("_p", "_q").count()
    most, n = cells.agg(F.max("count"), F.count(F.lit(1))).first()
    assert most < 2 * 100 * 1.6 and n == 50 * 51 // 2


def test_joins_do_not_change_with_bands(spark, monkeypatch):
    """A term, a word and a group that all rows have, cut into bands of 8."""
    import weft.operators.bands as bands

    docs = [(d, t, 1 + (d * t) % 3) for d in range(40) for t in [0, *range(1 + d % 5, 12, 2)]]
    weights = spark.createDataFrame(docs, "doc int, term int, n int")
    norm = weights.groupBy("doc").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    df = weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    kept = weights.join(norm, "doc").join(df, "term").withColumn("w", F.col("n") / F.col("norm"))
    sets = weights.groupBy("doc").agg(F.array_sort(F.collect_list(F.col("term").cast("string"))).alias("s"))
    rows = spark.createDataFrame([(g, f"t{i}") for g in (1, 2) for i in range(50 if g == 1 else 3) for _ in range(1 + i % 2)], "g int, x string")

    def all_three():
        cosine = sorted((r["i"], r["j"], round(r["sim"], 9)) for r in N.cosine_join(kept, "doc", "term", "w", "df", 0.6).collect())
        jaccard = sorted(map(tuple, N.jaccard_join(sets, "doc", "s", 0.5).collect()))
        return cosine, jaccard, sorted(map(tuple, cooccur_group(rows, "g", "x").collect()))

    want = all_three()
    assert all(want)
    plain = bands.banded
    monkeypatch.setattr(bands, "banded", lambda rows, key, item, band: plain(rows, key, item, 8))
    assert all_three() == want
