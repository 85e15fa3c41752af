import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weft.llm import bpe, tokens, tokenstore

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("abtheT 's\n\t.,1²éÉßẞİΣς ́\x1c日😀<|>-"), st.characters(codec="utf-8")), max_size=40)


@pytest.fixture(scope="module")
def encoders():
    return {p: tokens.Encoder(open(p, encoding="utf-8").read()) for p in (WORD, BYTE)}


@pytest.fixture(scope="module")
def codecs():
    return {p: bpe.ForcedBoundaryCodec(open(p, encoding="utf-8").read()) for p in (WORD, BYTE)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.sampled_from(["", "<|endoftext|>x", "a  b   c ", "don't 'll"])), max_size=6))
def test_encoder_gives_the_librarys_ids(encoders, texts):
    for e in encoders.values():
        flat, counts = e.encode(texts)
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [a.tolist() for a in np.split(flat, np.cumsum(counts)[:-1])] == want if texts else not len(flat)
        same, sizes = e.encode_column(pa.array(texts, pa.string()))
        assert same.tolist() == flat.tolist() and sizes.tolist() == counts.tolist()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_forced_boundaries_give_the_librarys_ids(codecs, text):
    for c in codecs.values():
        ids = c.whole.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == ids
        assert c.decode(ids) == c.whole.decode(ids, skip_special_tokens=False)


def test_cuts_are_at_pairs_of_no_token(codecs):
    c = codecs[WORD]
    assert c.cut("xqzzkv") == ["xq", "zzkv"] and c.cut("hello") == ["hello"]
    assert not any("qz" in s for s in c.spelling)


def test_long_texts_in_pieces_and_small_memory(docs, monkeypatch):
    texts = [r.text for r in docs.limit(60).collect()] + ["many words go here " * 4000]
    monkeypatch.setattr(tokens, "PIECE", 500)
    monkeypatch.setattr(tokens, "REMEMBERED", 200)
    monkeypatch.setattr(bpe, "REMEMBERED", 200)
    for path in (WORD, BYTE):
        spec = open(path, encoding="utf-8").read()
        e, c = tokens.Encoder(spec), bpe.ForcedBoundaryCodec(spec)
        flat, counts = e.encode(texts)
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert flat.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
        assert [c.encode(t) for t in texts[-8:]] == want[-8:]
        for limit in (100, 1 << 30):
            monkeypatch.setattr(tokens, "LONG", limit)
            for i in range(0, len(texts), 7):
                assert e.encode_column(pa.array(texts[i : i + 7]))[0].tolist() == [x for w in want[i : i + 7] for x in w]


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_codec_edge_rows(edge, no_rows):
    out = bpe.encoded_and_decoded(edge, WORD).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    t = Tokenizer.from_file(WORD)
    want = Counter()
    for r in edge.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())] += 1
    assert Counter(map(tuple, out)) == want
    assert bpe.encoded_and_decoded(no_rows, WORD).count() == 0


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(ids):
    values = np.array(ids, np.uint64)
    words, offsets = tokenstore.pack_words(values)
    assert (tokenstore.unpack_words(words, offsets, len(values)) == values).all()
    for b, first in enumerate(offsets.tolist()):  # a block by itself
        part = values[b * tokenstore.BLOCK : (b + 1) * tokenstore.BLOCK]
        last = int(offsets[b + 1]) if b + 1 < len(offsets) else len(words)
        assert (tokenstore.unpack_words(words[first:last], np.zeros(1, np.uint64), len(part)) == part).all()


def test_words_are_as_full_as_they_can_be():
    words, _ = tokenstore.pack_words(np.full(256, 32767, np.uint64))
    assert len(words) == 64  # four ids of 15 bits each
    assert len(tokenstore.pack_words(np.zeros(240, np.uint64))[0]) == 4


def test_damaged_files_are_refused():
    data = b"".join(f + b"\n" for f in tokenstore.frames(iter([(1, np.arange(5))])))
    assert len(list(tokenstore.read_frames(io.BytesIO(data)))) == 1
    with pytest.raises(ValueError):
        list(tokenstore.read_frames(io.BytesIO(data[:-9] + b"?" + data[-8:])))


def expected_files(rows):
    t, start, out = Tokenizer.from_file(WORD), 0, Counter()
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out[doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    return out


def test_token_files(edge, docs, no_rows, monkeypatch):
    monkeypatch.setattr(tokenstore, "FRAME", 1000)  # on the driver only; frames of the tasks are full size
    for df in (edge, docs):
        assert Counter(map(tuple, tokenstore.token_files(df, WORD).collect())) == expected_files([(r.doc_id, r.text) for r in df.collect()])
    assert tokenstore.token_files(no_rows, WORD).count() == 0


def test_documents_over_several_frames(monkeypatch):
    monkeypatch.setattr(tokenstore, "FRAME", 10)
    documents = [(3, np.arange(35)), (None, np.arange(4)), (4, np.zeros(0, int)), (5, np.arange(10))]
    got = []
    for ids, flags, counts, values in tokenstore.read_frames(io.BytesIO(b"".join(f + b"\n" for f in tokenstore.frames(iter(documents))))):
        for d, flag, part in zip(ids, flags, np.split(values, np.cumsum(counts)[:-1])):
            if flag & 2:
                got[-1][1].extend(part.tolist())
            else:
                got.append((None if flag & 1 else d, part.tolist()))
    assert got == [(d, v.tolist()) for d, v in documents]


def test_files_are_in_order_of_their_numbers(spark):
    names = [f"file:/x/part-1/part-{n}-a-c000.ids" for n in ("00002", "99999", "100000", "100001")]
    df = spark.createDataFrame([(p,) for p in reversed(names)], "path string")
    assert [r.path for r in df.orderBy(tokenstore.file_number(F.col("path")), "path").collect()] == names
