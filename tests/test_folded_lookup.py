"""Mean word vectors: tokens meet blocks of vectors and come back as one row per document and block."""

import pytest

from pyspark.sql import functions as F

from weft.operators import vectors as V

TOKENS = [(1, "a", 2.0), (1, "b", 1.0), (1, "x", 5.0), (2, "c", 3.0), (None, "b", 1.0), (3, "odd", 1.0), (3, "a", 1.0), (4, None, 1.0), (5, "gap", 2.0), (5, "b", 2.0), (6, "none", 1.0)]
VECTORS = [("a", [1.0, 2.0]), ("b", [3.0, -1.0]), ("b", [5.0, 1.0]), ("c", [0.5, 0.25]), ("odd", [1.0, 1.0, 9.0]), ("gap", [None, 4.0]), ("none", None), (None, [7.0, 7.0])]


@pytest.mark.parametrize("size, tokens", [(1 << 27, 4_000_000), (32, 2)])
def test_folded_rows_give_the_mean_of_all_rows(spark, monkeypatch, size, tokens):
    monkeypatch.setattr(V, "BLOCK_BYTES", size)
    monkeypatch.setattr(V, "BLOCK_TOKENS", tokens)
    t = spark.createDataFrame(TOKENS, "doc long, word string, n double")
    v = spark.createDataFrame(VECTORS, "word string, v array<double>")
    plain = V.lookup_word_vectors(t, "word", v, "v").select("doc", "n", F.posexplode("v").alias("d", "x"))
    want = {(r["doc"], r["d"]): r["m"] for r in plain.groupBy("doc", "d").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m")).collect()}
    folded = V.lookup_word_vectors(t, "word", v, "v", "doc", F.col("n"))
    got = V.mean_by(folded, ["doc"], "v", F.col("weight"), dim=V.width(v, "v")).select("doc", F.posexplode("mean").alias("d", "m")).collect()
    assert {(r["doc"], r["d"]): r["m"] for r in got} == pytest.approx(want)
    assert folded.filter("doc = 1").count() <= 2  # not one row per token and copy


def test_a_key_sends_one_row_of_sums(spark):
    """The plan has no row per dimension."""
    v = spark.createDataFrame([("k", [1.0, 2.0]), ("k", [3.0, None]), ("l", [4.0]), ("l", None), (None, [1.0])], "k string, v array<double>")
    mean = V.mean_by(v, ["k"], "v")
    assert "Generate" not in mean._jdf.queryExecution().optimizedPlan().toString()
    assert {r["k"]: r["mean"] for r in mean.collect()} == {"k": [2.0, 1.0], "l": [4.0], None: [1.0]}
