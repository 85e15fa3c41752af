import random
from collections import Counter

import numpy as np
import xxhash

from weft.llm import simhash


def brute_print(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    """prints: (id, fingerprint); the smallest id reachable, by fingerprint."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, f in prints:
        r = find(f)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return {f: least.get(find(f)) for f in fps}


def test_edge_rows(edge, no_rows):
    rows = [(r.doc_id, brute_print(r.text or "")) for r in edge.collect()]
    names = brute_components(rows)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(edge).collect())
    assert got == Counter((d, f"{f:016x}", names[f]) for d, f in rows)
    assert simhash.near_groups(no_rows).count() == 0 and simhash.drop_near_copies(no_rows).count() == 0


def test_documents(docs):
    rows = [(r.doc_id, brute_print(r.text or "")) for r in docs.collect()]
    names = brute_components(rows)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == {(d, f"{f:016x}", names[f]) for d, f in rows}


def test_dense_groups_and_chains(spark):
    """Fingerprints in dense balls and long chains over many small groups, against all pairs."""
    pick, fps = random.Random(1), []
    for _ in range(20):
        centre = pick.getrandbits(64)
        fps += [centre ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, 4))) for _ in range(60)]
    step = pick.getrandbits(64)
    for b in range(0, 60, 3):
        step ^= 7 << b
        fps.append(step)
    fps += [pick.getrandbits(64) for _ in range(500)]
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.near_links(nodes, 4, group_size=40)
    assert edges.count() < 4 * len(fps)
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    names = brute_components([(s, f) for s, f in zip(signed, fps)])
    assert {s: found.get(s, s) for s in signed} == {s: names[f] for s, f in zip(signed, fps)}


def test_long_chain_of_edges(spark):
    n = 300
    order = random.Random(2).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {r.component for r in simhash.components(edges).collect()} == {0}


def test_stage(edge):
    out = simhash.drop_near_copies(edge)
    assert out.columns == edge.columns
    assert {r.doc_id for r in out.collect()} >= {None, 1, 4} and 5 not in {r.doc_id for r in out.collect()}
