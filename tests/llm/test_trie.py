import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from weft.llm import trie
from weft.llm.slots import SlotTable

FIELDS = ["conv_id", "turn", "role", "text"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The nodes, from a dict of all beginnings."""
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    def tie(t):
        return hashlib.sha256(b"%d:%b%b" % (len(t[2].encode()), t[2].encode(), t[3].encode())).digest()
    turns = {c: [t[2:] for t in sorted(v, key=lambda t: (t[0], t[1], tie(t)))] for c, v in by.items()}
    nodes = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        path = (*turns.get(base, [])[:h], *turns[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
    out = []
    for p, found in nodes.items():
        ends = sorted(c for c, end in found if end)
        out.append((min(found)[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(found), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    df = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **kw)
    return sorted(map(tuple, df.collect()), key=str)


def made(n, longest, seed, words=("a", "b c", "d\x0be  f")):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in range(-n // 4, n) if rng.random() < 0.8 for t in range(rng.randint(0, longest))]


def test_equals_a_dictionary_of_beginnings(spark):
    rows = made(60, 6, 1)
    assert got(spark, rows) == brute(rows)


def test_chunks_do_not_matter(spark):
    """Long conversations, one of them many times over, cut into chunks of three turns."""
    same = [(20 + k, t, "user", f"turn {t}") for k in range(15) for t in range(17)]
    rows = same + [(400, t, "user", f"own {t}") for t in range(40)] + made(12, 9, 2)
    want = brute(rows)
    assert got(spark, rows, chunk=3) == want
    assert got(spark, rows) == want


def test_edge_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, "second"), (1, 0, "user", None), (1, 0, "user", None), (2, 1, "", ""),
        (None, 0, "user", "nobody"), (20, 5, "user", "x " * 50_000), (21, 0, "user", "x " * 50_000), (-3, 0, "a", "é 日本 語"), (40, 1, "1:u", "ser"),
        (41, 1, "1", ":user"), (41, 1, "1", ":user"),
    ]
    assert got(spark, rows) == brute(rows)


def test_no_rows_and_clashing_columns(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(20, 0, "user", "a b", 1, 2, "x")], SCHEMA + ", depth long, k1 long, `a.b` string")
    assert [r["conv_id"] for r in trie.prefix_trie(df).collect()] == [20, 20] and trie.prefix_trie(df.limit(0)).count() == 0


def test_conversations_without_turns(spark):
    """Without the first of its block, a conversation of fewer than h turns has none left."""
    rows = [(c, 0, "user", "only") for c in range(1, 20)]
    assert got(spark, rows) == brute(rows)


def test_heavy_parents_and_ids_in_parts(spark, monkeypatch):
    """Children of parents over the bound find them in the broadcast table; ids are hashed in parts."""
    rows = made(40, 4, 3) + [(c, 0, "user", "same") for c in range(400, 800, 20)]
    monkeypatch.setattr(trie, "MANY_CHILDREN", 2)
    monkeypatch.setattr(trie, "IDS", 2)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_slots_are_minimal_and_verified(n):
    rng = np.random.default_rng(n)
    first, second = rng.integers(0, 1 << 20, n).astype(np.uint64), np.arange(n, dtype=np.uint64)
    table = SlotTable(first, second)
    slots = table.slots(first, second)
    assert sorted(slots.tolist()) == list(range(n))
    assert (table.first[slots] == first).all() and (table.second[slots] == second).all()
    assert (table.slots(first, second + np.uint64(n)) == -1).all()


def test_equal_keys_are_refused():
    same = np.array([5, 5], np.uint64)
    with pytest.raises(ValueError):
        SlotTable(same, same)


def test_one_digest_for_two_beginnings_ends_the_job(spark):
    row = dict(k1=1, k2=1, p1=0, p2=0, t1=1, t2=1, words=1, n_convs=1, conv_id=1)
    schema = T.StructType.fromDDL(trie.NODE)
    rows = [tuple({**row, "depth": 1}[f.name] for f in schema), tuple({**row, "depth": 1, "t1": 2}[f.name] for f in schema)]
    with pytest.raises(Exception, match="two beginnings"):
        trie.node_table(spark.createDataFrame(rows, schema), spark.createDataFrame([(1,)], "conv_id long")).count()
