"""Token ids of whole texts, as the ``tokenizers`` library gives them, many texts at once.

No word of these tokenizers goes across a single space, so texts are split there and numbered by Arrow, and
only chunks that are new to the process are encoded. The library's pre-tokenizers are slow next
to its BPE model: a chunk of common characters is cut into words here by the same pattern, and each
new word goes to the library's model once. Any other chunk (rare scripts, control characters, special
tokens) is left to the library as it is. The ids are the library's in all cases.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from .common import ranges

#: Words, and chunks, remembered per worker process; beyond that the first half stays, which has the frequent ones.
REMEMBERED = 200_000
#: Words, and chunks, that a worker process keeps from one task to the next.
KEPT = 100_000
#: Bytes of text numbered at a time: the more, the fewer chunks are looked up twice.
ENCODED = 4 << 20
#: Bytes beyond which a text is encoded piece by piece.
LONG = 8 << 20
#: Characters handled at a time: the words of a piece are the peak of the memory.
PIECE = 1 << 20

#: Characters whose class and case are the same everywhere: printable Latin and common punctuation.
COMMON = [c for c in map(chr, (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA1, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0))) if c not in "İ­"]
LETTERS = "".join(c for c in COMMON if unicodedata.category(c)[0] == "L")
NUMBERS = "".join(c for c in COMMON if unicodedata.category(c)[0] == "N")
RARE = re.compile("[^" + re.escape("".join(COMMON)) + "]")

#: The endings that the tokenizers cut off (fixed values of their patterns).
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"


#: Stands between chunks that are cut into words in one go; rare, so never in a common chunk.
BREAK = "\0"


def word_pattern(config: dict) -> re.Pattern:
    """The pre-tokenizer's pattern over common characters; a ``BREAK`` ends what is before it and is a word of its own."""
    letter, number = f"[{LETTERS}]", f"[{NUMBERS}]"
    other = f"[^\\s{BREAK}{LETTERS}{NUMBERS}]"
    if config["pre_tokenizer"]["type"] == "ByteLevel":
        return re.compile(f"{ENDINGS}| ?{letter}+| ?{number}+| ?{other}+|\\s+(?![^\\s{BREAK}])|\\s+|{BREAK}")
    return re.compile(f"{ENDINGS}|{letter}+|{number}|{other}+|{BREAK}")


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


BYTE_LETTERS = byte_letters()


CODES = np.array([ord(c) for c in BYTE_LETTERS], np.uint32)
CODES[0] = 0  # a BREAK stays


def in_letters(words: list[str]) -> list[str]:
    """Common words as the vocabulary spells them: one character per UTF-8 byte."""
    data = np.frombuffer(BREAK.join(words).encode(), np.uint8)
    return CODES[data].tobytes().decode("utf-32-le").split(BREAK)


class Numbers(dict):
    """Numbers words as they come; the new ones since the last ``clear`` of ``fresh`` are listed there."""

    def __init__(self, known=()) -> None:
        super().__init__(known)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """Ids of many texts by one tokenizer file (given as its JSON text)."""

    def __init__(self, spec: str):
        config = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = any(n["type"] == "Lowercase" for n in (config["normalizer"] or {}).get("normalizers", []))
        self.pattern = word_pattern(config)
        self.spaced = config["pre_tokenizer"]["type"] == "ByteLevel"  # words begin with their space
        self.special = [t["content"] for t in config["added_tokens"]]
        self.model = Tokenizer(self.tokenizer.model)
        suffix = config["model"]["end_of_word_suffix"] or ""
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.width = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.forget_chunks()
        self.number[BREAK] = 0  # a word without ids
        self.flat, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def forget_chunks(self) -> None:
        self.chunks = Numbers()
        self.chunk_flat, self.chunk_starts, self.chunk_counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self, most: int | None = None, keep: int | None = None) -> None:
        """Keep what was learned first where more than ``most`` is remembered."""
        most = REMEMBERED if most is None else most
        keep = most // 2 if keep is None else keep
        if len(self.number) > most:
            self.number = Numbers(islice(self.number.items(), keep))
            self.starts, self.counts = self.starts[:keep].copy(), self.counts[:keep].copy()
            self.flat = self.flat[: int((self.starts + self.counts).max())].copy()
        if len(self.chunks) > most:
            self.chunks = Numbers(islice(self.chunks.items(), keep))
            self.chunk_starts, self.chunk_counts = self.chunk_starts[:keep].copy(), self.chunk_counts[:keep].copy()
            self.chunk_flat = self.chunk_flat[: int((self.chunk_starts + self.chunk_counts).max())].copy()

    def rest(self) -> None:
        """At the end of a task: give memory back, as the process may go on to other work."""
        self.trim(KEPT, KEPT)
        gc.collect()
        pa.default_memory_pool().release_unused()

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for a column of strings (NULL: empty)."""
        column = pc.fill_null(column, "")
        odd = pc.binary_length(column).to_numpy(zero_copy_only=False) > LONG
        if self.spaced:  # a run of spaces is cut by what follows it
            odd = odd | pc.match_substring(column, "  ").to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.encode_chunks(column)
        parts = self.encode_chunks(column.filter(pa.array(~odd))), self.encode(column.filter(pa.array(odd)).to_pylist())
        counts = np.zeros(len(column), np.int64)
        counts[~odd], counts[odd] = parts[0][1], parts[1][1]
        flat, starts = np.zeros(int(counts.sum()), np.uint32), np.cumsum(counts) - counts
        for which, (ids, lengths) in zip((~odd, odd), parts):
            flat[ranges(starts[which], lengths)] = ids
        return flat, counts

    def encode_chunks(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.trim()
        lists = pc.split_pattern(column, " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        names, known = coded.dictionary.to_pylist(), self.chunks
        keys = [" " + n for n in names] if self.spaced else names
        numbers = np.fromiter(map(known.get, keys, repeat(-1)), np.int64, len(keys))  # -1: not known yet
        new = np.flatnonzero(numbers < 0)
        known.fresh = list(map(keys.__getitem__, new.tolist()))
        numbers[new] = np.arange(len(known), len(known) + len(new))
        known.update(zip(known.fresh, range(len(known), len(known) + len(new))))
        index = numbers[coded.indices.to_numpy()]
        if self.spaced:  # the first chunk of a text has no space before it
            first = np.cumsum(sizes) - sizes
            start = [names[i] for i in coded.indices.to_numpy()[first].tolist()]
            index[first] = np.fromiter(map(known.__getitem__, start), np.int64, len(start))
        if known.fresh:
            self.learn_chunks(known.fresh)
            known.fresh = []
        lengths = self.chunk_counts[index]
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes)))]
        return self.chunk_flat[ranges(self.chunk_starts[index], lengths)], np.diff(ends)

    def learn_chunks(self, chunks: list[str]) -> None:
        """The ids of new chunks: their words in one go, rare chunks by the library."""
        joined = BREAK.join(chunks)
        rare: list[int] = []
        if joined.count(BREAK) >= len(chunks) or not self.common(joined.replace(BREAK, " ")):
            rare = [i for i, c in enumerate(chunks) if not self.common(c)]
            out = set(rare)
            joined = BREAK.join(["" if i in out else c for i, c in enumerate(chunks)])
        words = self.words_of(joined)
        index = self.indices(words)
        lengths = self.counts[index]
        breaks = np.flatnonzero(index == self.number[BREAK])
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], breaks, [len(index)]))]
        starts, counts = ends[:-1], np.diff(ends)
        flats = [self.flat[ranges(self.starts[index], lengths)]]
        at = int(ends[-1])
        for i, e in zip(rare, self.tokenizer.encode_batch_fast([chunks[i] for i in rare], add_special_tokens=False) if rare else ()):
            flats.append(np.array(e.ids, np.uint32))
            starts[i], counts[i] = at, len(flats[-1])
            at += len(flats[-1])
        self.chunk_starts = np.concatenate([self.chunk_starts, len(self.chunk_flat) + starts])
        self.chunk_counts = np.concatenate([self.chunk_counts, counts])
        self.chunk_flat = np.concatenate([self.chunk_flat, *flats])

    def learn(self, words: list[str]) -> None:
        """The ids of new words, all in one call; the widths of the tokens tell where a word ends."""
        spelled = in_letters(words)
        ids = np.array(self.model.encode_batch_fast([spelled], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(s) for s in spelled])) + 1
        counts = np.diff(ends, prepend=0)
        self.starts = np.concatenate([self.starts, len(self.flat) + ends - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, ids])

    def words_of(self, text: str) -> list[str]:
        return self.pattern.findall(text.lower() if self.lower else text)

    def common(self, text: str) -> bool:
        return not RARE.search(text) and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one text after another, and each text's number of ids."""
        flats, totals = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for owners, words, counts in self.batches(texts):
            self.trim()
            if words is None:
                ids = np.array(self.tokenizer.encode(texts[owners[0]], add_special_tokens=False).ids, np.uint32)
                totals[owners[0]] = len(ids)
            else:
                index = self.indices(words)
                lengths = self.counts[index]
                ids = self.flat[ranges(self.starts[index], lengths)]
                ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([0, *counts])]
                np.add.at(totals, owners, np.diff(ends))
            flats.append(ids)
        return np.concatenate(flats), totals

    def indices(self, words: list[str]) -> np.ndarray:
        known = self.number
        index = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.fresh:
            self.learn(known.fresh)
            known.fresh = []
        return index

    def batches(self, texts: list[str]) -> Iterator[tuple[list[int], list[str] | None, list[int]]]:
        """Words of about ``PIECE`` characters at a time: (text of each piece, words, words of each piece).

        A long text comes in several pieces. Words are None where the library encodes the text itself.
        """
        owners, words, counts, size = [], [], [], 0
        for i, text in enumerate(texts):
            if not self.common(text):
                if owners:
                    yield owners, words, counts
                    owners, words, counts, size = [], [], [], 0
                yield [i], None, []
                continue
            for piece in pieces(text):
                found = self.words_of(piece)
                owners.append(i)
                words += found
                counts.append(len(found))
                size += len(piece)
                if size >= PIECE:
                    yield owners, words, counts
                    owners, words, counts, size = [], [], [], 0
        if owners:
            yield owners, words, counts


#: A space between two other characters: no word goes across it.
CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of about ``PIECE`` characters, cut where no word can go across."""
    at = 0
    while len(text) - at > 2 * PIECE and (m := CUT.search(text, at + PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@functools.lru_cache(maxsize=4)
def encoder(spec: str) -> Encoder:
    """One encoder per worker process and tokenizer."""
    return Encoder(spec)


def shipped(spark: SparkSession, path: str):
    """A tokenizer file (a few MB) as a broadcast of its JSON text: only the driver needs the file."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())
