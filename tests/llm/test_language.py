import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import language
from weft.llm.wordlang import Words, emissions, entering, features, posteriors


def chain_brute(evidence, moves, begin):
    """Posteriors by the sum over all label sequences of one text."""
    n, size = evidence.shape
    total = np.zeros((n, size))
    for path in itertools.product(range(size), repeat=n):
        w = np.exp(begin[path[0]] + sum(moves[a, b] for a, b in zip(path, path[1:])) + sum(evidence[t, k] for t, k in enumerate(path)))
        for t, k in enumerate(path):
            total[t, k] += w
    return total / total.sum(axis=1, keepdims=True)


def chain_plain(evidence, moves, begin):
    """Posteriors of one text, step by step."""
    e, a = np.exp(evidence - evidence.max(axis=1, keepdims=True)), np.exp(moves)
    f, b = np.empty_like(e), np.ones_like(e)
    f[0] = np.exp(begin) * e[0]
    for t in range(1, len(e)):
        f[t] = f[t - 1] / f[t - 1].sum() @ a * e[t]
    for t in range(len(e) - 1, 0, -1):
        b[t - 1] = a @ (e[t] * b[t])
        b[t - 1] /= b[t - 1].sum()
    out = f * b
    return out / out.sum(axis=1, keepdims=True)


def test_posteriors_equal_all_sequences():
    rng = np.random.default_rng(1)
    texts = [rng.normal(size=(n, 3)) * 2 for n in (1, 5, 2, 6)]
    moves, begin = rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.concatenate([np.arange(len(t)) == 0 for t in texts])
    got = posteriors(np.concatenate(texts), first, moves, begin)
    assert np.abs(got - np.concatenate([chain_brute(t, moves, begin) for t in texts])).max() < 1e-12


@pytest.mark.parametrize("lengths", [[1], [31, 1, 33], [5000, 3, 32, 64], [1] * 200, [70_000]])
def test_posteriors_in_blocks(lengths):
    rng = np.random.default_rng(sum(lengths))
    texts = [rng.normal(size=(n, 4)) * 3 for n in lengths]
    moves, begin = rng.normal(size=(4, 4)) - 3 * (1 - np.eye(4)), rng.normal(size=4)
    first = np.concatenate([np.arange(n) == 0 for n in lengths])
    got = posteriors(np.concatenate(texts), first, moves, begin)
    assert np.abs(got - np.concatenate([chain_plain(t, moves, begin) for t in texts])).max() < 1e-9
    assert posteriors(np.zeros((0, 4)), np.zeros(0, bool), moves, begin).shape == (0, 4)


def test_entering_vectors():
    rng = np.random.default_rng(2)
    mats = rng.random((300, 3, 3))
    got, v = entering(mats, np.ones(3)), np.ones(3)
    for i in range(300):
        assert np.abs(got[i] / got[i].sum() - v / v.sum()).max() < 1e-12
        v = v @ mats[i] / (v @ mats[i]).sum()


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(3)
    emit, labels = rng.normal(size=(3, 5, 2)), rng.integers(0, 2, (3, 5))
    mask = np.arange(5) < np.array([5, 3, 1])[:, None]
    moves, begin = rng.normal(size=(2, 2)), rng.normal(size=2)

    def value(emit, moves, begin):
        total = 0.0
        for i in range(3):
            n = mask[i].sum()
            score = lambda p: begin[p[0]] + sum(moves[a, b] for a, b in zip(p, p[1:])) + sum(emit[i, t, k] for t, k in enumerate(p))
            total += score(labels[i, :n]) - np.logaddexp.reduce([score(p) for p in itertools.product(range(2), repeat=n)])
        return total

    got = language.likelihood_gradient(emit, labels, mask, moves, begin)
    for which, x in enumerate((emit, moves, begin)):
        for at in np.ndindex(*x.shape):
            x[at] += 1e-6
            up = value(emit, moves, begin)
            x[at] -= 2e-6
            down = value(emit, moves, begin)
            x[at] += 1e-6
            assert abs(got[which][at] - (up - down) / 2e-6) < 1e-6


def test_words_and_features():
    texts = ["", "A b1c", "élan VITAL", "日本語 123", "x"]
    words = Words(texts)
    found = [(t, texts[t][a - words.offsets[t] : b - words.offsets[t]]) for t, a, b in zip(words.text, words.starts, words.ends)]
    assert found == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\W\d_]+", t)]
    h = Words(["tHe the THE thé he"]).hashes()
    assert h[0] == h[1] == h[2] and len(set(h.tolist())) == 3
    w = Words(["abcde"])
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    # word, 5 letters, 6 pairs, 5 triples, beginnings and ends of 3 and 4 letters
    assert len(features(w, np.array([0]), w.hashes(), none)[0]) == 1 + 5 + 6 + 5 + 4
    same = emissions(Words(["b a", "a"]), np.arange(language.FEATURES, dtype=float)[:, None], none)
    assert same[1] == same[2] != same[0]


@pytest.fixture(scope="module")
def scored(spark, docs):
    return language.languages(docs).cache()


def test_held_out_accuracy(scored, docs):
    wrong = scored.join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> lang").count()
    held = scored.where("held_out").count()
    assert held > 20 and wrong <= 0.02 * held
    assert {r["doc_id"] for r in scored.where("held_out").collect()} == {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}


def test_held_out_labels_and_other_columns_are_never_read(spark, docs, scored):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("same"))
    cols = ["doc_id", "held_out", "lang_pred", "score", "spans"]
    assert sorted(language.languages(other).select(cols).collect()) == sorted(scored.select(cols).collect())


def test_switches_are_found(spark, docs, scored):
    """Halves of two documents of different languages, one after another: the words' labels change there."""
    by = {}
    for r in docs.orderBy("doc_id").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and len(r["text"]) > 400:
            by.setdefault(r["lang"], []).append(" ".join(r["text"][:400].split()))
    found = language.stretches(language.training_rows(docs.select("doc_id", "text", "lang"), 500, 8000)).collect()
    model = language.fit([tuple(r) for r in found])
    right = total = 0
    for (a, xs), (b, ys) in itertools.permutations(by.items(), 2):
        for x, y in zip(xs[:3], ys[:3]):
            words, p = model.words([f"{x} {y}"])
            want = np.where(words.starts < len(x), model.labels.index(a), model.labels.index(b))
            right, total = right + int((p.argmax(axis=1) == want).sum()), total + len(want)
    assert total > 500 and right > 0.95 * total
    spans = language.spans_of(*(lambda w, p: (w, p.argmax(axis=1)))(*model.words(["ab cd", ""])), model.labels, 2)
    assert re.fullmatch(r"0:5:\w+|0:2:\w+,3:5:\w+", spans[0]) and spans[1] == ""


def test_edge_rows(edge, no_rows):
    rows = language.languages(edge).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert (r["lang_pred"] == "und") == (r["n_words"] == 0) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (4, 5, 6)} == {"und"}
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert language.languages(no_rows).collect() == []
    nothing = language.languages(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    one = language.languages(edge.withColumn("lang", F.lit("q"))).collect()
    assert {r["lang_pred"] for r in one if r["n_words"]} == {"q"}


def test_training_rows_are_bounded(spark, docs):
    rows = language.training_rows(docs.select("doc_id", "text", "lang"), 5, 12)
    assert rows.count() <= 12 and rows.groupBy("lang").count().agg(F.max("count")).first()[0] <= 5
