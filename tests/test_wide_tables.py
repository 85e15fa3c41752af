"""Steps whose cells, messages or vocabulary must not sit in one row, one task or the driver."""

import os

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

import __spark_entry__
from weft.functions.kernels import KERNELS
from weft.operators import clustering as C
from weft.operators import reduction as D
from weft.operators import topics as T
from weft.plans.sources import model_save_load
from weft.session import scratch_path, shared_dir


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def made(spark, tmp_path):
    """A folder of small tables: one word in every text."""
    def text(k):
        return " ".join(w for i in range(6) for w in ("hot", f"w{(k * 7 + i * 3) % 23}"))

    spark.createDataFrame([(k, text(k), "en", "s", 1) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k // 3, k % 3, "user", text(k)) for k in range(40)] + [(99, 0, "user", None)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(k, [k + 0.25, -k / 3], k % 2) for k in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_word_vectors_are_no_cells(spark, made):
    got = __spark_entry__.queries()["word_vectors_per_doc"](spark, made)
    assert "collect_list" not in plan(got)
    rows, seen, top, w = got.collect(), {}, 0.0, {}
    texts = [r["text"].split() for r in spark.read.parquet(f"{made}/conversations.parquet").collect() if r["text"]]
    for t in texts:
        for a in range(len(t)):
            for b in range(a + 1, min(len(t), a + 6)):
                w[t[a], t[b]] = w.get((t[a], t[b]), 0) + 6 - (b - a)
    top = max(w.values())
    for (a, b), x in w.items():
        for word in (a, b):
            n, s = seen.get(word, (0, 0.0))
            seen[word] = n + 1, s + x / top
    assert len(rows) == sum(map(len, texts))
    assert all(r["n_dims"] == seen[r["w"]][0] and abs(r["total"] - seen[r["w"]][1]) < 2e-6 for r in rows)


def test_a_vector_is_written_as_text_once(spark, made):
    got = __spark_entry__.queries()["index_documents"](spark, made)
    assert "round(" not in plan(got) and "millionths" not in plan(got)
    known = {",".join(str(round(x * 1000000)) for x in np.float32([k + 0.25, -k / 3]).astype(float).tolist()) for k in range(5)}
    rows = got.collect()
    assert len(rows) == 40 * 12 and {r["v"] for r in rows} <= known


def test_affinity_stores_no_messages(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(300, 2)))], "id bigint, v array<double>")
    folder = shared_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs)
    before = size()
    assert C.affinity_bins(df, "id", "v", rounds=2, block_rows=100).count() == 300
    assert size() - before < 300 * 300 * 8  # not even one number per pair


def test_word_vectors_stay_tables(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet").select(F.split("text", " ").alias("t")).unionByName(spark.createDataFrame([(None,), ([],), (["x", None],)], "t array<string>"))
    model = T.word2vec(docs, "t", dim=4)
    assert not hasattr(model, "_java_obj")
    got = {r["word"]: r["vector"] for r in T.model_vectors(model).collect()}
    assert set(got) == {"hot", "x", *(f"w{i}" for i in range(23))} and all(len(v) == 4 and np.isfinite(v).all() for v in got.values())
    path = scratch_path(spark, "model")
    PipelineModel([model]).write().save(path)
    back = PipelineModel.load(path).stages[0]
    assert {r["word"]: r["vector"] for r in T.model_vectors(back).collect()} == got
    means = back.transform(docs.limit(2).unionByName(spark.createDataFrame([(["unknown"],)], "t array<string>"))).collect()
    assert [len(r["vec"] or []) for r in means] == [4, 4, 0]
    assert all(r["same"] and r["dim"] == 8 for r in model_save_load(spark, made).collect())


def test_scree_errors_add_up_from_classes(spark, monkeypatch):
    """Equal to all pairs one by one; rows without length, copies and NULL labels included."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(60, 4)), np.zeros((2, 4)), np.ones((3, 4))])
    labels = [None if i % 9 == 0 else i % 3 for i in range(len(x))]
    df = spark.createDataFrame([(i, r.tolist(), c) for i, (r, c) in enumerate(zip(x, labels))], "id bigint, v array<double>, c int")
    monkeypatch.setattr(D, "KERNELS", {})  # no pair goes through a distance kernel
    got = {(r["method"], r["dim"]): r["score"] for r in D.scree_table(df, "id", "v", "c", [1, 2, 4]).collect()}
    assert len(got) == 6
    truth = np.array([[float(a is None or b is None or a != b) for b in labels] for a in labels])
    upper = np.triu(np.ones(truth.shape, bool), 1)
    for name, fn in {"svd": D.svd, "pca": D.pca}.items():
        z = np.array([r["z"] for r in fn(df, "id", "v", 4).orderBy("id").collect()])
        for d in (1, 2, 4):
            dist = np.nan_to_num(KERNELS["cosine"]({"v": z[:, :d]}, {"v": z[:, :d]}))
            want = 1 - 2 * np.abs(truth - dist / dist.max())[upper].sum() / len(x) ** 2
            assert abs(got[name, d] - want) < 1e-9
