"""Small hand-made cases, brute force and invariants for what SQL cannot express."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import text as X
from weft.operators import classify as Y
from weft.operators import clustering as C
from weft.operators import hmm as M
from weft.operators import neighbours as N
from weft.operators import paths as H
from weft.operators import ranking as K
from weft.operators import reduction as D
from weft.operators import relational as R
from weft.operators import textops as T
from weft.operators import topics as TP
from weft.operators import vectors as V
from weft.operators.cooccur import cooccur_group
from weft.operators.order import positions
from weft.operators.pairwise import nearest, pairwise
from weft.session import scratch_path
from weft.sources import html
from weft.streaming import streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_vectors(spark, n=60, d=6, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + rng.integers(0, 4, size=(n, 1)) * 3
    return x, frame(spark, [(i, row.tolist()) for i, row in enumerate(x)], "id bigint, v array<double>")


# ---------------------------------------------------------------- order


def test_positions_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{i % 40}", rng.random(), i) for i in range(3000)]
    got = positions(frame(spark, rows, "k string, o double, i bigint"), ["k"], ["o", "i"]).collect()
    want = {}
    for k, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        want.update({r[2]: n + 1 for n, r in enumerate(group)})
    assert {r["i"]: r["pos"] for r in got} == want


def test_group_concat_parts_are_the_whole_document(spark):
    rows = [("a", i, f"t{i}") for i in range(25)] + [("b", 0, "x")]
    got = R.group_concat_docs(frame(spark, rows, "k string, o int, t string"), "k", "t", ["o"], part_size=10).collect()
    parts = {(r["k"], r["part"]): r["doc"] for r in got}
    assert len(parts) == 4
    assert ".".join(parts["a", p] for p in range(3)) == ".".join(f"t{i}" for i in range(25))


# ---------------------------------------------------------------- text


def test_clean_keywords(spark):
    df = frame(spark, [("Big Data; a big-data ;x;Tree", None)], "t string, u string")
    assert df.select(X.clean_keywords(F.col("t"))).first()[0] == "big data;tree"
    assert df.select(X.clean_keywords(F.coalesce("u", F.lit("")))).first()[0] == ""


def test_nested_enrich_with_and_without_cascade(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', named_struct('x', CAST(NULL AS INT)), 'b', array(named_struct('v', 7))) AS r")
    paths = {"first": "a.x", "second": "b[0].v"}
    assert tuple(T.nested_enrich(df, "r", paths).first()) == (1, None, 7)
    assert tuple(T.nested_enrich(df, "r", paths, cascade=True).first()) == (1, None, None)


# ---------------------------------------------------------------- distances and joins


def test_nearest_and_pairs_agree_with_brute_force(spark):
    x, df = random_vectors(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {(r["i"], r["j"]): r["dist"] for r in pairwise(df, "id", "euclidean", block_rows=7).collect()}
    assert len(got) == 60 * 59 // 2
    assert all(abs(v - d[k]) < 1e-9 for k, v in got.items())
    near = nearest(df, "id", "euclidean", 3, block_rows=7).collect()
    for i in range(60):
        want = sorted((d[i, j], j) for j in range(60) if j != i)[:3]
        assert [r["neighbour"] for r in sorted(near, key=lambda r: r["rank"]) if r["item"] == i] == [j for _, j in want]


@pytest.mark.parametrize("same", [0, 30])
def test_value_ranges_lose_no_pair(spark, same):
    x, _ = random_vectors(spark)
    x[:same, 0] = 1.0  # one value holds half of the rows
    df = frame(spark, [(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>")
    plain = {tuple(r)[:2] for r in pairwise(df, "id", "euclidean", 3.0).collect()}
    ranged = {tuple(r)[:2] for r in pairwise(df, "id", "euclidean", 3.0, 5, F.get("v", F.lit(0)), 3.0).collect()}
    assert plain == ranged and plain


def test_energy_of_two_point_samples(spark):
    df = frame(spark, [(0, [0.0, 0.0]), (1, [1.0, 1.0])], "id bigint, v array<double>")
    assert pairwise(df, "id", "energy").first()["dist"] == pytest.approx(math.sqrt(2))
    assert pairwise(df, "id", "emd").first()["dist"] == pytest.approx(1.0)


def test_zero_vector_has_no_cosine(spark):
    df = frame(spark, [(0, [0.0, 0.0]), (1, [1.0, 1.0])], "id bigint, v array<double>")
    assert pairwise(df, "id", "cosine").first()["dist"] is None


def word_docs(seed=3, n=80):
    rng = random.Random(seed)
    docs = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rng.randint(1, 12))] for _ in range(n)]
    return docs + [docs[0]] * (n // 2)  # a group of copies holds a third of the rows


def test_cosine_join_agrees_with_brute_force(spark):
    docs = word_docs()
    toks = frame(spark, [(i, w) for i, d in enumerate(docs) for w in d], "doc int, term string")
    tv = V.tfidf_vectors(toks, "doc", "term")
    reps, members = N.fold_weighted(tv, "doc", "term", "tf")
    assert members.count() == len(docs)
    kept = tv.join(reps, "doc", "left_semi")
    vec = {}
    for r in kept.collect():
        vec.setdefault(r["doc"], {})[r["term"]] = r["w"]
    for t in (0.3, 0.6, 0.9):
        want = {(i, j) for i in vec for j in vec if i < j and sum(w * vec[j].get(k, 0) for k, w in vec[i].items()) >= t}
        assert {(r["i"], r["j"]) for r in N.cosine_join(kept, "doc", "term", "w", "df", t).collect()} == want


def test_jaccard_join_agrees_with_brute_force(spark):
    docs = word_docs(5)
    sets = frame(spark, [(i, sorted(set(d))) for i, d in enumerate(docs)], "doc int, s array<string>")
    reps, _ = N.fold_copies(sets, "doc", ["s"])
    s = {r["doc"]: set(r["s"]) for r in reps.collect()}
    for dist in (0.3, 0.5, 0.8):
        want = {(i, j) for i in s for j in s if i < j and 1 - len(s[i] & s[j]) / len(s[i] | s[j]) <= dist + 1e-12}
        assert {(r["i"], r["j"]) for r in N.jaccard_join(reps, "doc", "s", dist).collect()} == want


# ---------------------------------------------------------------- paths


def test_path_distances_by_hand(spark):
    exams = [(p, s, c, 1, 3.0, i) for p, order in (("a", "wxyz"), ("b", "wxyz"), ("r", "zyxw")) for i, (s, c) in enumerate(enumerate(order))]
    df = frame(spark, exams, "path_id string, semester int, course string, grade int, ects double, event_id int")
    everyone = frame(spark, [("a",), ("b",), ("r",), ("none",)], "path_id string")
    items = H.path_items(H.dedup_course_first(df), everyone)
    d = {(r["i"], r["j"]): r["dist"] for r in H.path_distance(items, "order").collect()}
    assert d["a", "b"] == 0 and d["a", "r"] == 6
    e = {(r["i"], r["j"]): r["dist"] for r in H.path_distance(items, "path_emd").collect()}
    assert e["a", "b"] == 0 and e["a", "r"] == 0 and e["a", "none"] == pytest.approx(1.5)
    share = {(r["i"], r["j"]): r["dist"] for r in H.path_distance(items, "order_share").collect()}
    assert share["a", "b"] == 0 and share["a", "r"] == 1


def test_failed_and_repeated_courses(spark):
    rows = [("p", 0, "c", 5, 2.0, 1), ("p", 1, "c", 2, 2.0, 2), ("p", 2, "c", 1, 2.0, 3), ("q", 0, "d", 5, 1.0, 4)]
    df = frame(spark, rows, "path_id string, semester int, course string, grade int, ects double, event_id int")
    assert [tuple(r) for r in H.dedup_course_first(df).select("path_id", "course", "semester").collect()] == [("p", "c", 1)]


# ---------------------------------------------------------------- greedy selections


def test_author_selection_equals_the_walk(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(0, 10**6)) for i in range(200)]
    authors = {i: {rng.randint(0, 60) if rng.random() > 0.2 else 0 for _ in range(3)} for i, _ in rows}
    used, want = set(), set()
    for i, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if not authors[i] & used:
            used |= authors[i]
            want.add(i)
    a = frame(spark, [(i, x) for i, s in authors.items() for x in s], "id int, author int")
    got = K.author_disjoint_select(frame(spark, rows, "id int, o int"), "id", ["o"], a, "author")
    assert {r["id"] for r in got.collect()} == want


@pytest.mark.parametrize("batch", [3, 500])
def test_keyword_budget_equals_the_walk(spark, batch):
    rng = random.Random(9)
    rows = [(i, i * 2, [f"k{rng.randint(0, 60)}" for _ in range(rng.randint(0, 6))]) for i in range(150)]
    have, want = set(), set()
    for i, _, keys in rows:
        if keys and len(have) + len(keys) <= 40:
            have |= set(keys)
            want.add(i)
    got = K.keyword_budget_select(frame(spark, rows, "id int, r int, keys array<string>"), "id", "r", "keys", 40, batch)
    assert {r["id"] for r in got.collect()} == want


# ---------------------------------------------------------------- models


def test_svd_error_falls_and_signs_repeat(spark):
    x, df = random_vectors(spark)
    gone = []
    for d in (1, 3, 6):
        z = np.array([r["z"] for r in D.svd(df, "id", "v", d).orderBy("id").collect()])
        gone.append((x**2).sum() - (z**2).sum())
    assert gone[0] > gone[1] > gone[2] - 1e-9 and abs(gone[2]) < 1e-6
    long = df.select("id", F.posexplode("v").alias("c", "w"))
    z = np.array([r["z"] for r in D.svd_long(long, "id", "c", "w", 6, rounds=1).orderBy("id").collect()])
    assert (z**2).sum() == pytest.approx((x**2).sum())


def test_mds_of_few_items_keeps_distances(spark):
    x, df = random_vectors(spark, 20, 2)
    z = np.array([r["z"] for r in D.mds(df, "id", "v", 2).orderBy("id").collect()])
    d = lambda m: np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    assert np.allclose(d(x), d(z), atol=1e-6)


@pytest.mark.parametrize("loss", ["frobenius", "kl"])
def test_nmf_loss_never_rises(spark, loss):
    rng = random.Random(3)
    rows = [(i, j, rng.random() + 0.1) for i in range(12) for j in range(8) if rng.random() < 0.6]
    left, right, losses = D.nmf(frame(spark, rows, "r int, c int, w double"), "r", "c", "w", 3, rounds=3, loss=loss)
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    assert all(min(r["h"]) >= 0 for r in left.collect() + right.collect())


def test_topic_mixtures_sum_to_one(spark):
    docs = frame(spark, [(i, ["a", "b"] * 3 if i % 2 else ["c", "d"] * 3) for i in range(10)], "id int, t array<string>")
    for r in TP.lda(docs, "id", "t", 2, max_iter=3).collect():
        assert sum(r["mixture"]) == pytest.approx(1.0)


def test_dbscan_chain_noise_and_row_order(spark):
    pts = [(i, [float(i), 0.0]) for i in range(30)] + [(40, [100.0, 0.0]), (50, [30.9, 0.0])]
    for rows in (pts, pts[::-1]):
        got = {r["id"]: r["cluster"] for r in C.dbscan(frame(spark, rows, "id bigint, v array<double>"), "id", "euclidean", 1.0, 3, 4).collect()}
        # the two ends have one neighbour each, so the lowest core item is 1
        assert {got[i] for i in range(30)} == {1} and got[40] == -1 and got[50] == -1


def merged_pair_by_pair(d):
    """Heights and memberships of weighted average linkage, the nearest pair first."""
    d, members, out = d.copy(), {i: {i} for i in range(len(d))}, []
    np.fill_diagonal(d, np.inf)
    while len(members) > 1:
        live = sorted(members)
        i, j = min(((a, b) for n, a in enumerate(live) for b in live[n + 1:]), key=lambda p: d[p])
        out.append((float(d[i, j]), frozenset(members[i] | members[j])))
        members[i] |= members.pop(j)
        mean = (d[i] + d[j]) / 2
        d[i], d[:, i] = mean, mean
        d[i, i] = np.inf
    return out


def test_linkage_in_rounds_equals_pair_by_pair(spark):
    x, df = random_vectors(spark, 40)
    merges, path = C.linkage_weighted(pairwise(df, "id", "euclidean"), df, "id")
    want = merged_pair_by_pair(np.linalg.norm(x[:, None] - x[None], axis=2))
    assert sorted(round(r["height"], 9) for r in merges.collect()) == sorted(round(h, 9) for h, _ in want)
    under = {}
    for r in path.collect():
        for m in r["merges"]:
            under.setdefault(m, set()).add(r["id"])
    assert {frozenset(s) for s in under.values()} == {s for _, s in want}
    for k in (1, 3, 40):
        assert C.flat_clusters(merges, path, "id", k).select("cluster").distinct().count() == k
    assert 0 < C.cophenetic_corr(df, "id", "euclidean", path).first()["corr"] <= 1


def test_linkage_leaves_out_items_without_distances(spark):
    rows = [(0, [0.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.2]), (3, [0.1, 1.0])]
    df = frame(spark, rows, "id bigint, v array<double>")
    merges, path = C.linkage_weighted(pairwise(df, "id", "cosine"), df, "id")
    heights = sorted(r["height"] for r in merges.collect())
    assert len(heights) == 2 and all(h == h for h in heights)
    assert {r["id"]: len(r["merges"]) for r in path.collect()} == {0: 0, 1: 2, 2: 2, 3: 1}


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_scaling_equals_the_full_decomposition(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6)) * [9, 5, 1, 1, 0.5, 0.3]
    df = frame(spark, [(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>")
    if metric == "euclidean":
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
    else:
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
    centre = np.eye(120) - 1 / 120
    vals, vecs = np.linalg.eigh(-0.5 * centre @ d**2 @ centre)
    want = vecs[:, ::-1][:, :2] * np.sqrt(vals[::-1][:2])
    got = np.array([r["z"] for r in D.mds(df, "id", "v", 2, metric).orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-5)
    assert np.allclose(np.linalg.norm(got[:, None] - got[None], axis=2), np.linalg.norm(want[:, None] - want[None], axis=2), atol=1e-5)


def test_affinity_finds_two_groups(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.3, (15, 2)), rng.normal(9, 0.3, (15, 2))])
    got = C.affinity_bins(frame(spark, [(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>"), "id", "v", rounds=20)
    side = {}
    for r in got.collect():
        side.setdefault(r["exemplar"] < 15, set()).add(r["id"] < 15)
    assert side == {True: {True}, False: {False}}


@pytest.mark.parametrize("block_rows", [7, 100])
def test_affinity_in_blocks_equals_the_whole_matrix(spark, block_rows):
    x, df = random_vectors(spark, 24)
    n, rounds = len(x), 12
    s = -((x[:, None] - x[None]) ** 2).sum(axis=2)
    s[np.diag_indices(n)] = np.median(s[~np.eye(n, dtype=bool)])
    r, a = np.zeros_like(s), np.zeros_like(s)
    for _ in range(rounds):
        both = a + s
        new = np.array([[s[i, k] - max(both[i, q] for q in range(n) if q != k) for k in range(n)] for i in range(n)])
        r = 0.5 * r + 0.5 * new
        pos = np.maximum(r, 0)
        pos[np.diag_indices(n)] = np.diag(r)
        new = pos.sum(axis=0)[None, :] - pos
        new[~np.eye(n, dtype=bool)] = np.minimum(new[~np.eye(n, dtype=bool)], 0)
        a = 0.5 * a + 0.5 * new
    chosen = np.flatnonzero(np.diag(r + a) > 0)
    want = {i: i if i in chosen or not len(chosen) else int(chosen[s[i, chosen].argmax()]) for i in range(n)}
    got = C.affinity_bins(df, "id", "v", rounds=rounds, still=99, block_rows=block_rows).collect()
    assert {r["id"]: r["exemplar"] for r in got} == want


# ---------------------------------------------------------------- sequences and streams

DIE = M.Model((0.5, 0.5), ((0.7, 0.3), (0.3, 0.7)), ((0.9, 0.1), (0.2, 0.8)))
PHONES = M.Model((1, 0, 0), ((0.3, 0.7, 0), (0, 0.9, 0.1), (0, 0, 0.4)),
                 ((0.5, 0.3, 0.2, 0, 0, 0, 0), (0, 0, 0.2, 0.7, 0.1, 0, 0), (0, 0, 0, 0.1, 0, 0.5, 0.4)))


def observed(spark, symbols):
    return frame(spark, [("s", i, int(c)) for i, c in enumerate(symbols)], "k string, t int, sym int")


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_hmm_textbook_values(spark, chunk):
    ev = observed(spark, "00100")
    f = [r["f"][0] for r in M.hmm_forward(ev, "k", ["t"], "sym", DIE, chunk).orderBy("step").collect()]
    assert np.allclose(f, [0.81818, 0.88336, 0.19067, 0.73079, 0.86733], atol=1e-5)
    g = [r["g"][0] for r in M.hmm_posterior(ev, "k", ["t"], "sym", DIE, chunk).orderBy("step").collect()]
    assert np.allclose(g, [0.86733, 0.82042, 0.30748, 0.82042, 0.86733], atol=1e-5)


@pytest.mark.parametrize("fan", [2, 3])
def test_hmm_scan_in_levels(spark, monkeypatch, fan):
    """One key holds a third of the events: all levels of the scan agree with the step-by-step values."""
    monkeypatch.setattr(M, "FAN", fan)
    rng = random.Random(fan)
    rows = [("hot", i, rng.randint(0, 1)) for i in range(60)] + [(f"u{i % 9}", i, rng.randint(0, 1)) for i in range(120)]
    rows += [("hot", 1000, 7), ("hot", 1001, -1), ("hot", 1002, None), ("odd", 0, 9)]  # no symbols of the model
    events = frame(spark, rows, "k string, t int, sym int")
    init, t, e = DIE.arrays()
    got = {(r["k"], r["step"]): r for r in M.hmm_posterior(events, "k", ["t"], "sym", DIE, 2).collect()}
    fwd = {(r["k"], r["step"]): r["f"] for r in M.hmm_forward(events, "k", ["t"], "sym", DIE, 2).collect()}
    best = {(r["k"], r["step"]): r for r in M.hmm_viterbi(events, "k", ["t"], "sym", DIE, 2).collect()}
    keys = {k for k, *_ in rows} - {"odd"}
    assert {k for k, _ in got} == keys
    for k in keys:
        seq = [s for q, _, s in sorted(rows, key=lambda r: r[1]) if q == k and s in (0, 1)]
        f, fs = init, []
        for n, s in enumerate(seq):
            f = M.unit((f if n == 0 else f @ t) * e[:, s])
            fs.append(f)
        b, gs = np.ones(2), []
        for f, s in zip(fs[::-1], seq[::-1]):
            gs.append(M.unit(f * b))
            b = M.unit(t @ (e[:, s] * b))
        v, back = np.log(init) + np.log(e[:, seq[0]]), []
        for s in seq[1:]:
            reach = v[:, None] + np.log(t)
            back.append(reach.argmax(axis=0))
            v = reach.max(axis=0) + np.log(e[:, s])
        path = [int(v.argmax())]
        for step in back[::-1]:
            path.append(int(step[path[-1]]))
        assert np.allclose([fwd[k, n] for n in range(len(seq))], fs) and np.allclose([got[k, n]["g"] for n in range(len(seq))], gs[::-1])
        assert [best[k, n]["state"] for n in range(len(seq))] == path[::-1]


@pytest.mark.parametrize("chunk", [3, 100])
def test_viterbi_path_is_the_best_of_all(spark, chunk):
    seq = "01233456"
    init, t, e = PHONES.arrays()
    best = max(itertools.product(range(3), repeat=len(seq)), key=lambda p: init[p[0]] * e[p[0], int(seq[0])] * np.prod(
        [t[p[i - 1], p[i]] * e[p[i], int(seq[i])] for i in range(1, len(seq))]))
    rows = M.hmm_viterbi(observed(spark, seq), "k", ["t"], "sym", PHONES, chunk).orderBy("step").collect()
    assert tuple(r["state"] for r in rows) == best


def test_stream_filter_equals_batch_over_several_files(spark):
    folder = scratch_path(spark, "events")
    rng = random.Random(4)
    rows = [(f"u{rng.randint(0, 3)}", i, rng.randint(0, 1)) for i in range(90)]
    for part in range(3):
        frame(spark, rows[part * 30:part * 30 + 30], "k string, t int, sym int").coalesce(1).write.mode("append").parquet(folder)
    stream = streams.file_stream(spark, folder, "k string, t int, sym int")
    got = streams.run_to_table(spark, streams.hmm_filter_stream(stream, "k", ["t"], "sym", DIE), "f").collect()
    want = M.hmm_forward(frame(spark, rows, "k string, t int, sym int"), "k", ["t"], "sym", DIE).collect()
    key = lambda r: (r["k"], r["step"])
    assert np.allclose([r["f"] for r in sorted(got, key=key)], [r["f"] for r in sorted(want, key=key)])


# ---------------------------------------------------------------- edge cases


def test_cooccurrence_of_a_large_group(spark):
    rows = spark.range(6000).select(F.lit(1).alias("g"), F.col("id").alias("x")).unionByName(spark.range(2).select(F.lit(2).alias("g"), F.col("id").alias("x")))
    sums = cooccur_group(rows, "g", "x")
    assert sums.filter("a < 3 AND b < 3").count() == 6
    assert {(r["a"], r["b"]): r["weight"] for r in sums.filter("a < 2 AND b < 2").collect()} == {(0, 1): 1.0, (1, 0): 1.0}


def test_a_class_without_a_name(spark):
    df = frame(spark, [(1, "a"), (2, "a"), (3, None)], "m int, c string")
    sizes = {r["class"]: r["n"] for r in R.label_sizes(df, "c").collect()}
    assert sizes == {"a": 2, None: 1, "all": 3}
    members = R.group_by_label_members(df, "c", "m").groupBy("class").count().collect()
    assert {r["class"]: r["count"] for r in members} == sizes


def test_terms_fold_case(spark):
    df = frame(spark, [(1, "Spark spark SPARK"), (2, None), (3, "")], "d int, t string")
    rows = V.tfidf_vectors(V.tokenize_custom(df, "d", "t", X.folded_space_words), "d", "term").collect()
    assert {(r["d"], r["term"], r["tf"]) for r in rows} == {(1, "spark", 3), (3, "", 1)}


def test_html_by_class_and_nesting(spark):
    page = (
        '<div id="x" class="ad">A</div><div class="big ad">B &amp; b<div>C</div>D</div><p class="ad">no</p><div class="bad">no</div>'
        "<div class='ad'>E<div class=ad>F</div></div><a data-href='/no' href='/yes.pdf'>x</a><A HREF=/two.pdf>y</A><link href='/no.pdf'>"
    )
    df = frame(spark, [(1, page), (2, None), (3, "")], "k int, h string")
    got = [(r["k"], r["pos"], r["text"]) for r in html.html_extract(df, "k", "h", "div", "ad").orderBy("k", "pos").collect()]
    assert got == [(1, 0, "A"), (1, 1, "B & b C D"), (1, 2, "E F"), (1, 3, "F")]
    links = [(r["link"], r["file"]) for r in html.html_links(df, "k", "h", ".", ".pdf").orderBy("pos").collect()]
    assert links == [("/yes.pdf", "yes.pdf"), ("/two.pdf", "two.pdf")]


def test_median_of_a_hot_key(spark):
    rows = [("hot", float(i)) for i in range(999)] + [("even", 1.0), ("even", 4.0), ("none", None), (None, 7.0)]
    got = {r["k"]: r["median"] for r in R.median_of_runs(frame(spark, rows, "k string, x double"), ["k"], "x").collect()}
    assert got == {"hot": 499.0, "even": 2.5, None: 7.0}


def test_prototypes_in_several_blocks(spark):
    x, df = random_vectors(spark, 60)
    named = df.withColumn("label", F.col("id") % 7)
    centres = Y.class_centres(named, "v", "label")
    one = {(r["id"], r["label"]): r["sim"] for r in Y.prototype_similarities(named, "id", "v", centres, "label").collect()}
    two = {(r["id"], r["label"]): r["sim"] for r in Y.prototype_similarities(named, "id", "v", centres, "label", block=2).collect()}
    assert one == two and len(one) == 420
    assert Y.mean_similarity(named, "v", centres) == pytest.approx(np.mean(list(one.values())))


def test_clusters_become_document_histograms(spark):
    clusters = frame(spark, [(1, 40), (2, 40), (3, 7), (4, -1)], "w int, cluster int")
    words = frame(spark, [("d", 1), ("d", 2), ("d", 3), ("d", 4), ("e", 4), ("f", 3), ("f", 9)], "doc string, w int")
    got = {(r["doc"], r["cluster"]): (r["n"], r["share"]) for r in C.doc_bins(words, "doc", "w", clusters).collect()}
    assert got == {("d", 0): (1, 0.0), ("d", 1): (2, 1.0), ("f", 0): (1, 1.0), ("f", 1): (0, 0.0)}
