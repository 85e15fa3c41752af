import zlib
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from weft.llm import toxicity


def brute(scores):
    """Maximal segments by their definition: the best segment, then the same to its left and right."""
    best = None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            s = sum(scores[i : j + 1])
            if s > 0 and (best is None or s > best[0]):
                best = (s, i, j)
    if best is None:
        return []
    s, i, j = best
    return brute(scores[:i]) + [(i, j, s)] + [(a + j + 1, b + j + 1, x) for a, b, x in brute(scores[j + 1 :])]


@given(st.lists(st.sampled_from([0, 0, 0, 1, 2, 3, 5, -2, -4, 7]), max_size=14))
def test_segments(raw):
    drift = 0.7131  # no two segments have the same score
    positions = [i for i, s in enumerate(raw) if s]
    got = toxicity.segments(positions, [raw[i] for i in positions], drift)
    want = brute([s - drift for s in raw])
    assert abs(sum(s for *_, s in got) - sum(s for *_, s in want)) < 1e-9
    assert [round(s, 6) for *_, s in got] == [round(s, 6) for *_, s in want]


def test_decay_solves_its_equation():
    import numpy as np

    scores, shares = np.array([2.0, -1.0]), np.array([0.1, 0.9])
    x = toxicity.decay(scores, shares)
    assert abs((shares * np.exp(x * scores)).sum() - 1) < 1e-6


def test_held_out(spark):
    """Words that only toxic texts have are learned from the training rows and found in the others."""
    pad = " ".join(f"word{chr(97 + i)}" for i in range(20))
    rows = [(i, f"{pad} {'grumpf' if i % 3 == 0 else 'flower'} {pad} {'snarkel' if i % 3 == 0 else ''} text{chr(97 + i % 26)}", int(i % 3 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert all(out[i].predicted == y and (out[i].score >= 0.5) == (y == 1) for i, _, y in rows)
    assert all((out[i].n_passages > 0) == (y == 1) for i, _, y in rows)


def test_held_out_labels_are_never_read(spark):
    docs = spark.createDataFrame([(i, f"grumpf {i}" if i % 2 else "flower") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    lies = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2) for i in range(300)], "doc_id long, toxic int")
    score = lambda y: {r.doc_id: r.score for r in toxicity.toxicity(docs, y).collect()}
    assert score(labels) == score(lies)


def test_edge_rows(spark, edge, no_rows):
    some = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (7, 0), (7, 1)], "doc_id long, toxic int")
    for labels in (some, some.limit(0), some.where("toxic = 0")):
        out = toxicity.toxicity(edge, labels).collect()
        assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in edge.collect())
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
        assert all(r.held_out for r in out if r.doc_id is None)
    assert toxicity.toxicity(no_rows, some).count() == 0


def test_entries_are_chosen_by_their_share(spark):
    """An entry stays if it is at least one in ``one_in``; no rank drops a significant one."""
    rows = [(f"w{i:04d}", 40, 1) for i in range(3000)] + [("rare", 2, 0), ("plain", 10, 2_000_000)]
    counts = spark.createDataFrame(rows, "word string, t long, c long")
    words, share, rest = toxicity.lexicon(counts, 1_000_000)
    assert {f"w{i:04d}" for i in range(3000)} <= set(words) and 0 < rest < 1 and set(share) == set(words)
    total = sum(t + c for _, t, c in rows)
    assert set(toxicity.lexicon(counts, total // 41 - 1)[0]) <= {"plain"}
    assert set(words) >= set(toxicity.lexicon(counts, total // 41 + 1)[0]) >= {f"w{i:04d}" for i in range(3000)}
