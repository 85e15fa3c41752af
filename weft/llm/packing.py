"""Packing of token ids into windows by the sum-of-squares rule.

Every task packs the documents of its own partition, in the order it reads them, with a level array:
``open_at[h]`` counts the windows filled up to level h. A piece goes to the level that makes the sum
of the squared counts smallest, a new window being level zero. Full windows leave at once; the
array and the unfinished windows are all that a task holds. A document longer than a window is cut
into full windows and a rest. Where pieces don't fit each other and unfinished windows come to hold OPEN_IDS,
the emptiest are cut to fill the fullest until half of that is left; so is what is unfinished at the end, and the
last window is cut to powers of two, which need no padding.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_schema, keyed, slices, small_batches
from .tokens import ENCODED, encoder, shipped

WINDOW = 2048
#: Ids in unfinished windows at most (and a window more).
OPEN_IDS = 1 << 21
#: Rows of an output batch.
ROWS = 4096
END_ID = 1
#: Sequence ids are partition * 2^SEQUENCE_BITS + number within the task.
SEQUENCE_BITS = 33


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


@dataclass
class Window:
    fill: int = 0
    pieces: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.fill += len(piece.ids)


class Packer:
    """Online packing of pieces; finished windows are handed out as lists of pieces."""

    def __init__(self, size: int = WINDOW, most: int = OPEN_IDS):
        self.size, self.most, self.held = size, most, 0
        self.open_at = np.zeros(size + 1, np.int64)
        self.windows: list[list[Window]] = [[] for _ in range(size + 1)]

    def level_for(self, length: int) -> int:
        """The level whose use makes the sum of squares smallest; the fuller one on ties."""
        n, size = self.open_at, self.size
        levels = np.flatnonzero(n[: size - length + 1])
        target = np.where(levels + length == size, 0, 2 * n[levels + length] + 1)
        change = np.concatenate(([1 + 2 * n[length] if length < size else 0], 1 - 2 * n[levels] + target))
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best - 1]) if best else 0

    def place(self, piece: Piece) -> Window | None:
        """Put a piece of at most one window; the window if that fills it."""
        level = self.level_for(len(piece.ids))
        if level:
            window = self.windows[level].pop()
            self.open_at[level] -= 1
        else:
            window = Window()
        window.add(piece)
        self.held += len(piece.ids)
        if window.fill == self.size:
            self.held -= self.size
            return window
        self.keep(window)
        return None

    def keep(self, window: Window) -> None:
        self.windows[window.fill].append(window)
        self.open_at[window.fill] += 1

    def document(self, doc_id: int | None, ids: np.ndarray) -> Iterator[Window]:
        for start in range(0, len(ids), self.size):
            part = ids[start : start + self.size]
            done = self.place(Piece(doc_id, start, part if len(part) == self.size else part.copy(), len(ids)))
            if done:
                yield done
            if self.held > self.most:
                yield from self.drain(self.most // 2)

    def drain(self, least: int) -> Iterator[Window]:
        """Cut the emptiest windows to fill the fullest, until at most ``least`` ids are in unfinished ones (or less than a window)."""
        left = deque(w for level in self.windows for w in level)  # the emptiest first
        self.windows = [[] for _ in self.windows]
        self.open_at[:] = 0
        spare: list[Piece] = []
        while left and self.held > least:
            window = left.pop()
            while window.fill < self.size and (spare or left):
                if not spare:
                    spare = left.popleft().pieces[::-1]
                window.add(self.cut(spare, self.size - window.fill))
            if window.fill == self.size:
                self.held -= self.size
                yield window
            else:
                spare = window.pieces[::-1]
        if spare:
            rest = Window()
            for piece in reversed(spare):
                rest.add(piece)
            left.append(rest)
        for window in left:
            self.keep(window)

    def finish(self) -> Iterator[Window]:
        """The unfinished windows, cut to fill each other; the last one as powers of two."""
        yield from self.drain(0)
        spare = [p for level in self.windows for w in level for p in w.pieces][::-1]
        rest = sum(len(p.ids) for p in spare)
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                part = Window()
                while part.fill < 1 << bit:
                    part.add(self.cut(spare, (1 << bit) - part.fill))
                yield part

    @staticmethod
    def cut(spare: list[Piece], room: int) -> Piece:
        """The last piece of ``spare`` if it fits, else as much of it as does."""
        piece = spare.pop()
        if len(piece.ids) <= room:
            return piece
        spare.append(Piece(piece.doc_id, piece.start + room, piece.ids[room:], piece.doc_tokens))
        return Piece(piece.doc_id, piece.start, piece.ids[:room], piece.doc_tokens)


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def packed(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    A document's ids are the tokenizer's and ``end_id``; so NULL and empty texts have one id. Each id lies in one
    piece; a sequence's pieces follow each other from offset 0, and its length is ``window`` or a power of
    two. NULL ids and repeated rows are packed like any other; an empty table gives no rows.
    Nothing is shuffled: a lost task packs its partition again the same way.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    spec = shipped(df.sparkSession, tokenizer)
    schema = arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(window), TaskContext.get().partitionId() << SEQUENCE_BITS
        encode = encoder(spec.value).encode_column
        end = np.array([end_id], np.uint32)

        def rows(windows: Iterator[Window]) -> Iterator[tuple]:
            nonlocal number
            for w in windows:
                offset = 0
                for p in w.pieces:
                    yield p.doc_id, p.start, len(p.ids), p.doc_tokens, number, offset, p.ids.tobytes()
                    offset += len(p.ids)
                number += 1

        def full(batch: pa.RecordBatch) -> Iterator[Window]:
            flat, counts = encode(batch.column("text"))
            ends = np.cumsum(counts)
            for doc_id, stop, n in zip(batch.column("doc_id").to_pylist(), ends.tolist(), counts.tolist()):
                yield from packer.document(doc_id, np.concatenate([flat[stop - n : stop], end]))

        for batch in slices(batches, "text", ENCODED):
            yield as_batch(list(rows(full(batch))), schema)
        for some in batched(rows(packer.finish()), ROWS):
            yield as_batch(list(some), schema)
        encoder(spec.value).rest()

    return small_batches(keyed(df, id_col, text_col)).mapInArrow(run, SCHEMA)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
