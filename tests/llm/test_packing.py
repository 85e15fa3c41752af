import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weft.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.integers(1, 70), max_size=60))
def test_every_id_lies_in_one_piece_and_nothing_is_padded(lengths):
    packer, windows = packing.Packer(16), []
    for d, n in enumerate(lengths):
        windows += packer.document(d, np.arange(n))
    windows += packer.finish()
    seen = defaultdict(list)
    for w in windows:
        assert w.fill == sum(len(p.ids) for p in w.pieces)
        assert w.fill <= 16 and w.fill & (w.fill - 1) == 0
        for p in w.pieces:
            seen[p.doc_id].append((p.start, p.ids.tolist()))
    for d, n in enumerate(lengths):
        assert [i for _, ids in sorted(seen[d]) for i in ids] == list(range(n))


@given(st.lists(st.integers(0, 5), min_size=16, max_size=16), st.integers(1, 15))
def test_level_minimises_the_sum_of_squares(counts, length):
    packer = packing.Packer(16)
    packer.open_at[1:16] = counts[1:]
    squares = {}
    for h in range(0, 17 - length):
        n = packer.open_at.copy()
        if h and not n[h]:
            continue
        n[h] -= h > 0
        if h + length < 16:
            n[h + length] += 1
        squares[h] = int((n[1:16] ** 2).sum())
    assert squares[packer.level_for(length)] == min(squares.values())


def check(rows, source):
    t = Tokenizer.from_file(BYTE)
    left = Counter()
    for doc_id, text in source:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        left[doc_id, np.array(ids, "<u4").tobytes()] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
    total = sum(len(k[1]) * n for k, n in left.items())
    assert sum(len(p) for ps in pieces.values() for _, p in ps) == total
    for (doc_id, ids), n in left.items():
        mine = pieces[doc_id, len(ids) // 4]
        for start, part in mine:
            assert any(d == doc_id and len(i) == len(ids) and i[4 * start : 4 * start + len(part)] == part for d, i in left)
        assert sum(len(p) for _, p in mine) == sum(len(i) * m for (d, i), m in left.items() if d == doc_id and len(i) == len(ids))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_edge_rows(edge, no_rows):
    check(packing.packed(edge, BYTE).collect(), [(r.doc_id, r.text) for r in edge.collect()])
    assert packing.packed(no_rows, BYTE).count() == 0


def test_documents(docs):
    out = packing.packed(docs.repartition(3, "doc_id"), BYTE)
    check(out.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert zlib.crc32(b"") == 0


def test_unfinished_windows_are_bounded():
    """Documents of which no two fit into a window: the unfinished ones never hold more than the bound and a window."""
    packer, ids, seen, windows, most = packing.Packer(2048), np.arange(1100, dtype=np.uint32), Counter(), 0, 0
    n = 1_000_000

    def take(found):
        nonlocal windows
        for w in found:
            windows += 1
            assert w.fill == 2048
            for p in w.pieces:
                seen[p.doc_id] += len(p.ids)

    for d in range(n):
        take(packer.document(d, ids))
        most = max(most, packer.held)
    assert most <= packing.OPEN_IDS + 2048
    assert packer.held == sum(w.fill for level in packer.windows for w in level)
    rest = list(packer.finish())
    for w in rest:
        assert w.fill & (w.fill - 1) == 0
        for p in w.pieces:
            seen[p.doc_id] += len(p.ids)
    assert len(seen) == n and set(seen.values()) == {1100}
    assert windows * 2048 + sum(w.fill for w in rest) == 1100 * n


@given(st.lists(st.integers(1, 40), max_size=60), st.integers(0, 60))
def test_any_bound_keeps_every_id_once(lengths, most):
    packer, windows = packing.Packer(16, most), []
    for d, n in enumerate(lengths):
        windows += packer.document(d, np.arange(n))
        assert packer.held <= max(most, 15)
    seen = defaultdict(list)
    for w in [*windows, *packer.finish()]:
        assert w.fill & (w.fill - 1) == 0 and w.fill <= 16
        for p in w.pieces:
            seen[p.doc_id] += [(p.start, p.ids.tolist())]
    for d, n in enumerate(lengths):
        assert [i for _, ids in sorted(seen[d]) for i in ids] == list(range(n))
