"""BPE encoding by forced boundaries, and decoding.

A byte pair that never occurs inside any vocabulary token can't lie inside a merge, so a word may be cut there:
the merges on either side never meet. Words are cut at all such pairs, each distinct fragment is
encoded on its own (the last one of a word with the vocabulary's word end), and the ids
are put together again. Fragments are shorter and rarer than words, so most are known already.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from .common import keyed, per_batch
from .tokens import RARE, in_letters, pieces, shipped, word_pattern

#: Words and fragments remembered per worker process before it starts anew.
REMEMBERED = 500_000


class ForcedBoundaryCodec:
    """Encodes and decodes with one tokenizer file (given as its JSON text)."""

    def __init__(self, spec: str):
        config = json.loads(spec)
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        vocab, merges = config["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in config["model"]["merges"]]
        self.suffix = config["model"]["end_of_word_suffix"] or ""
        self.inner = Tokenizer(models.BPE(vocab, merges))
        self.final = Tokenizer(models.BPE(vocab, merges, end_of_word_suffix=self.suffix)) if self.suffix else self.inner
        every = self.whole.get_vocab()
        self.token = [""] * (max(every.values()) + 1)
        for t, i in every.items():
            self.token[i] = t
        self.spelling = [t.removesuffix(self.suffix) if self.suffix else t for t in self.token]
        self.width = np.array([len(t) for t in self.spelling], np.int64)
        added = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.inside = {a + b for t, i in vocab.items() for a, b in pairwise(self.spelling[i])}
        self.lower = any(n["type"] == "Lowercase" for n in (config["normalizer"] or {}).get("normalizers", []))
        self.pattern = word_pattern(config)
        self.added, self.special = added, re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, tuple] = {}
        self.fragments: dict[tuple[str, bool], tuple] = {}

    def cut(self, spelled: str) -> list[str]:
        """The fragments of a word spelled in byte letters."""
        at = [k for k, (a, b) in enumerate(pairwise(spelled), 1) if a + b not in self.inside]
        return [spelled[i:j] for i, j in pairwise([0, *at, len(spelled)])]

    def learn(self, words: list[str], spelled: list[str]) -> None:
        """Remember the ids of new words: cut them, encode the new fragments, put together.

        A word without a cut is its own fragment and is remembered as a word only.
        """
        parts = [self.cut(s) for s in spelled]
        known = self.fragments
        inner = dict.fromkeys(f for p in parts if len(p) > 1 for f in p[:-1] if (f, False) not in known)
        final = dict.fromkeys(p[-1] for p in parts if (p[-1], True) not in known)
        single = {p[0] for p in parts if len(p) == 1}
        once: dict[str, tuple] = {}
        for fragment, ids in self.ids_of(self.inner, list(inner)):
            known[fragment, False] = ids
        ends = {p[-1] for p in parts if len(p) > 1}
        for fragment, ids in self.ids_of(self.final, list(final)):
            if fragment in single:
                once[fragment] = ids
            if fragment in ends:
                known[fragment, True] = ids
        for word, p in zip(words, parts):
            last = once.get(p[-1]) or known[p[-1], True]
            self.words[word] = last if len(p) == 1 else tuple(i for f in p[:-1] for i in known[f, False]) + last

    def ids_of(self, model: Tokenizer, strings: list[str]) -> Iterator[tuple[str, tuple]]:
        """Each string's ids, all encoded in one call; the widths of the tokens tell where a string ends."""
        if strings:
            ids = np.array(model.encode(strings, is_pretokenized=True, add_special_tokens=False).ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(f) for f in strings])) + 1
            flat = tuple(ids.tolist())
            for f, i, j in zip(strings, [0, *ends.tolist()], ends.tolist()):
                yield f, flat[i:j]

    def pre_tokens(self, text: str) -> tuple[list[str], bool]:
        """The words of a text without special tokens, and whether they are spelled in byte letters already."""
        if RARE.search(text):
            if self.whole.normalizer:
                text = self.whole.normalizer.normalize_str(text)
            return [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)], True
        return self.pattern.findall(text.lower() if self.lower else text), False

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            for piece in pieces(part) if part else ():
                self.extend(out, *self.pre_tokens(piece))
        return out

    def extend(self, out: list[int], words: list[str], spelled: bool) -> None:
        if len(self.words) + len(self.fragments) > REMEMBERED:
            self.forget()
        if spelled:  # their keys must not be taken for plain words
            keys = ["\0" + w for w in words]
            fresh = dict.fromkeys(w for w, k in zip(words, keys) if k not in self.words)
            if fresh:
                self.learn(["\0" + w for w in fresh], list(fresh))
            words = keys
        else:
            fresh = [w for w in dict.fromkeys(words) if w not in self.words]
            if fresh:
                self.learn(fresh, in_letters(fresh))
        known = self.words
        for w in words:
            out += known[w]

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False); without a decoder that is the tokens joined by a space."""
        if self.whole.decoder is not None:
            return self.whole.decode(ids, skip_special_tokens=False)
        token = self.token
        return " ".join([token[i] for i in ids])


@functools.lru_cache(maxsize=2)
def codec(spec: str) -> ForcedBoundaryCodec:
    return ForcedBoundaryCodec(spec)


def encoded_and_decoded(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    NULL texts are empty (no ids; the digests of nothing). NULL ids and repeated rows are kept; an empty
    table gives no rows; other columns are not read. Nothing is shuffled.
    """
    spec = shipped(df.sparkSession, tokenizer)

    def run(ids: list, texts: list[str]) -> dict:
        c = codec(spec.value)
        counts, coded, decoded = [], [], []
        for t in texts:
            tokens = c.encode(t)
            counts.append(len(tokens))
            coded.append(hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(c.decode(tokens).encode()).hexdigest())
        return {"doc_id": ids, "n_tokens": counts, "ids_sha256": coded, "decoded_sha256": decoded}

    return per_batch(keyed(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
