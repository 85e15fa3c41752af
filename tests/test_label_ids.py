"""Labels as numbers from a distributed dictionary."""

from pyspark.sql import functions as F

from weft.operators import textops as T
from weft.operators import topics as Y


def test_hundred_thousand_classes(spark):
    n = 100_000
    label = lambda c: F.lpad((c % n).cast("string"), 6, "0")
    rows = spark.range(n).select("id", F.explode(F.array(label(F.col("id")), label(F.col("id") + 1), label(F.col("id") * 7), label(F.col("id")))).alias("l")).withColumnRenamed("id", "doc")
    classes = T.label_classes(rows, "l")
    assert classes.count() == n and classes.filter(F.col("label").cast("bigint") != F.col("id")).isEmpty()
    coded = T.multilabel_encode(rows, "doc", "l", classes)
    want = F.array_sort(F.array_distinct(F.array(F.col("doc"), (F.col("doc") + 1) % n, (F.col("doc") * 7) % n)))
    assert coded.filter(F.col("ids") != want).isEmpty() and coded.count() == n
    back = T.multilabel_decode(coded, "doc", "ids", classes).filter("doc = 5").first()
    assert back["labels"] == "000005;000006;000035"


def test_edges(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None), (3, "x"), (None, "a")], "k int, l string")
    classes = T.label_classes(rows.filter("k IS NULL OR k < 3"), "l")
    coded = T.multilabel_encode(rows, "k", "l", classes)
    got = {r["k"]: r["ids"] for r in coded.collect()}
    assert got == {1: [0, 1], 2: [], 3: [], None: [0]}
    assert {r["k"]: r["labels"] for r in T.multilabel_decode(coded, "k", "ids", classes).collect()} == {1: "a;b", 2: "", 3: "", None: "a"}
    bits = coded.select("k", T.dense_bits("ids", 2).alias("b")).collect()
    assert {r["k"]: r["b"] for r in bits} == {1: "11", 2: "00", 3: "00", None: "10"}
    assert T.label_classes(rows.filter("false"), "l").count() == 0


def test_top_words_are_those_of_the_model(spark):
    docs = spark.createDataFrame([(["a", "b", "a"],), (["c", "d", "c"],), (["a", "d"],)], "t array<string>")
    cv, model, _ = Y.lda_model(docs, "t", 2, max_iter=2)
    got = {(r["topic"], r["rank"]): (r["word"], r["weight"]) for r in Y.lda_top_words(cv, model, 3).collect()}
    want = {(r["topic"], k + 1): (cv.vocabulary[i], w) for r in model.describeTopics(3).collect() for k, (i, w) in enumerate(zip(r["termIndices"], r["termWeights"]))}
    assert got == want
