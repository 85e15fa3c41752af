"""Token files in Simple-8b, written in document order and read back.

A file is a row of frames. A frame holds some documents (or a part of one), and closes with its
CRC-32 and the mark that Spark's writer puts after each row:

    magic 4s | documents u32 | ids u64 | words u64 | blocks u32 | block size u32        header
    document ids i64[] | flags u8[] (1: no id, 2: goes on from the frame before) | counts u64[]
    block offsets u64[] (first word of each block) | words u64[] | CRC-32 u32 | mark

Blocks of a fixed number of ids start at word boundaries, so any block can be decoded without the
ones before it, and all blocks of a frame together. A word has a selector of 4 bits and 60 bits of
ids; selector 15 is the escape: the id is the whole next word.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, keyed, open_shared, ranges, scratch_path, slices, small_batches
from .tokens import ENCODED, encoder, shipped

#: Selector s packs COUNTS[s] ids of WIDTHS[s] bits (the widths of Simple-8b without its runs of zeros).
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = 60 // WIDTHS
ESCAPE = 15
BLOCK = 256
#: Ids per frame, so a frame is about a megabyte.
FRAME = 1 << 18
MAGIC = b"S8BF"
MARK = "\n"
HEAD = struct.Struct("<4sIQQII")


#: Bits of each number below 2^16.
BITS16 = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
#: Ids that a word of each selector takes.
TAKES = np.array([*COUNTS, 0, 1])
#: Columns of a block with the zeros behind it that fill its last word.
ROW = BLOCK + 60


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Significant bits of unsigned 64-bit numbers."""
    wide = BITS16[values & np.uint64(0xFFFF)]
    for shift in (16, 32, 48):
        high = values >> np.uint64(shift)
        if not high.any():
            break
        part = BITS16[high & np.uint64(0xFFFF)]
        wide = np.where(part > 0, part + np.uint8(shift), wide)
    return wide


def selectors(wide: np.ndarray) -> np.ndarray:
    """For each position: the selector that packs the most ids from there on, by the greatest width among them."""
    best = np.full(len(wide), ESCAPE, np.uint8)
    greatest, reach = {1: wide}, 1
    while reach < 32:
        last = greatest[reach]
        greatest[2 * reach] = np.maximum(last, np.concatenate([last[reach:], np.zeros(reach, np.uint8)]))
        reach *= 2
    for s in range(len(WIDTHS) - 1, -1, -1):  # from few wide ids to many narrow ones
        n = int(COUNTS[s])
        half = greatest[1 << (n.bit_length() - 1)]
        rest = n - (1 << (n.bit_length() - 1))
        most = half if not rest else np.maximum(half, np.concatenate([half[rest:], np.zeros(rest, np.uint8)]))
        best[most <= WIDTHS[s]] = s
    return best


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of the ids; all blocks step together from word to word."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[:n] = ids
    table = np.zeros((blocks, ROW), np.uint64)
    table[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    values = table.ravel()
    choice = selectors(bit_widths(values))
    at = np.arange(blocks) * ROW
    end = at + BLOCK
    end[-1] = at[-1] + n - (blocks - 1) * BLOCK
    begins = np.zeros(len(values), bool)  # where a word begins
    while len(at):
        begins[at] = True
        at = at + TAKES[choice[at]]
        open_ = at < end
        at, end = at[open_], end[open_]
    starts = np.flatnonzero(begins)
    chosen = choice[starts]
    escapes = chosen == ESCAPE
    place = np.arange(len(starts)) + np.cumsum(escapes) - escapes
    words = np.zeros(len(starts) + int(escapes.sum()), np.uint64)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        word = np.full(len(rows), np.uint64(s) << np.uint64(60))
        for i in range(COUNTS[s]) if s != ESCAPE else ():
            word |= values[starts[rows] + i] << np.uint64(i * WIDTHS[s])
        words[place[rows]] = word
    words[place[escapes] + 1] = values[starts[escapes]]
    return words, place[np.searchsorted(starts, np.arange(blocks) * ROW)].astype(np.uint64)


def unpack_words(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids (uint64) of a frame's words; the inverse of ``pack_words``."""
    if not n:
        return np.zeros(0, np.uint64)
    raw = escaped_words(words, offsets)
    selector = np.where(raw, 16, words >> np.uint64(60)).astype(np.int64)  # 16: a whole word
    count = np.array([*COUNTS, 0, 0, 1])[selector]
    starts = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(starts[-1]), np.uint64)
    for s in range(len(WIDTHS)):
        rows = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for i in range(COUNTS[s]) if len(rows) else ():
            out[starts[rows] + i] = (words[rows] >> np.uint64(i * WIDTHS[s])) & mask
    rows = np.flatnonzero(selector == 16)
    out[starts[rows]] = words[rows]
    first = starts[offsets.astype(np.int64)]  # of each block; what follows its ids are fill zeros
    sizes = np.full(len(offsets), block)
    sizes[-1] = n - (len(offsets) - 1) * block
    return out[ranges(first, sizes)]


def escaped_words(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which words are whole ids: those behind an escape that is not itself such a word."""
    marked = words >> np.uint64(60) == ESCAPE
    raw = np.zeros(len(words), bool)
    if marked.any():
        starts = {*offsets.tolist()}
        for i in np.flatnonzero(marked).tolist():  # escapes are rare: ids of more than 60 bits
            if i + 1 < len(words) and not raw[i] and i + 1 not in starts:
                raw[i + 1] = True
    return raw


def frame(doc_ids: list, flags: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    words, offsets = pack_words(ids)
    body = b"".join([
        HEAD.pack(MAGIC, len(doc_ids), len(ids), len(words), len(offsets), BLOCK),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), bytes(flags), np.array(counts, "<u8").tobytes(),
        offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def frames(documents: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[bytes]:
    """Frames of at most ``FRAME`` ids; a longer document goes on in the next frame."""
    held: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for doc_id, ids in documents:
        start = 0
        while start < len(ids) or not start:
            part = ids[start : start + FRAME - size]
            for column, value in zip(held, (doc_id, (doc_id is None) | 2 * (start > 0), len(part), part)):
                column.append(value)
            size += len(part)
            start += len(part)
            if size >= FRAME:
                yield frame(*held[:3], np.concatenate(held[3]))
                held, size = ([], [], [], []), 0
            if not len(ids):
                break
    if held[0]:
        yield frame(*held[:3], np.concatenate(held[3]))


def read_frames(stream) -> Iterator[tuple[list, bytes, np.ndarray, np.ndarray]]:
    """(document ids, flags, counts, ids) of each frame; a damaged frame is an error."""
    while head := stream.read(HEAD.size):
        magic, n_docs, n_ids, n_words, n_blocks, block = HEAD.unpack(head)
        body = stream.read(17 * n_docs + 8 * n_blocks + 8 * n_words)
        (crc,) = struct.unpack("<I", stream.read(4))
        if magic != MAGIC or zlib.crc32(body, zlib.crc32(head)) != crc or stream.read(1) != MARK.encode():
            raise ValueError("damaged token file")
        at = 17 * n_docs
        doc_ids = np.frombuffer(body, "<i8", n_docs).tolist()
        flags, counts = body[8 * n_docs : 9 * n_docs], np.frombuffer(body, "<u8", n_docs, 9 * n_docs)
        offsets = np.frombuffer(body, "<u8", n_blocks, at)
        words = np.frombuffer(body, "<u8", n_words, at + 8 * n_blocks)
        yield doc_ids, flags, counts.astype(np.int64), unpack_words(words, offsets, n_ids, block)


def write_tokens(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, files: int | None = None) -> None:
    """Write the ids of every text, each with ``end_id``, in ascending id order to token files below ``path``.

    NULL texts are empty (one id); NULL ids come first; rows that repeat an id follow each other in the order
    of their texts. An empty table gives files without frames. Spark's writer commits the files, so
    a lost task leaves nothing behind. ``files`` is the number of id ranges (default: shuffle partitions).
    """
    spark = df.sparkSession
    spec = shipped(spark, tokenizer)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed(df, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, np.ndarray]]:
        encode, end = encoder(spec.value).encode_column, np.array([end_id], np.uint32)
        for batch in slices(batches, "text", ENCODED):
            flat, counts = encode(batch.column("text"))
            for doc_id, stop, k in zip(batch.column("doc_id").to_pylist(), np.cumsum(counts).tolist(), counts.tolist()):
                yield doc_id, np.concatenate([flat[stop - k : stop], end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in frames(documents(batches)):
            yield pa.RecordBatch.from_pydict({"frame": pa.array([data], pa.binary())})
        pa.default_memory_pool().release_unused()  # the process goes on to other tasks

    made = small_batches(ordered).mapInArrow(run, "frame binary").select(F.col("frame").cast("string"))  # the bytes as they are
    made.write.option("lineSep", MARK).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files below ``path``: doc_id, start, n_tokens, ids_crc32.

    Files are read in parallel, a frame at a time; the ids before a file come from the files' sums.
    """
    listed = spark.read.format("binaryFile").load(path).select("path")

    def documents(name: str) -> Iterator[tuple]:
        start = n = crc = 0
        current: tuple | None = None
        with open_shared(name) as stream:
            for doc_ids, flags, counts, ids in read_frames(stream):
                data, at = memoryview(ids.astype("<u4").tobytes()), 0
                for doc_id, flag, count in zip(doc_ids, flags, counts.tolist()):
                    if not flag & 2:
                        if current:
                            yield (*current, n, crc)
                        start, n, crc = start + n, 0, 0
                        current = (None if flag & 1 else doc_id, start)
                    crc = zlib.crc32(data[4 * at : 4 * (at + count)], crc)
                    at, n = at + count, n + count
            if current:
                yield (*current, n, crc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows = list(zip(*documents(name)))
                if rows:
                    columns = [pa.array(c, pa.int64()) for c in rows]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows[0])), *columns], names=["path", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = listed.mapInArrow(run, "path string, doc_id long, at long, n_tokens long, ids_crc32 long")
    rows = cut(rows)
    sums = rows.groupBy("path").agg(F.sum("n_tokens").alias("n"))
    before = cut(sums.select("path", (F.sum("n").over(W.orderBy(file_number(F.col("path")), "path")) - F.col("n")).alias("base")))
    return rows.join(before, "path").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def file_number(path: Column) -> Column:
    """The number that Spark gave a file; beyond five digits the names don't sort like it."""
    return F.regexp_extract(path, r"part-(\d+)[^/]*$", 1).cast("long")


def token_files(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``df`` to the shared folder and read them back (see ``read_tokens``)."""
    path = scratch_path(df.sparkSession, "tokens")
    write_tokens(df, tokenizer, path, id_col, text_col)
    return read_tokens(df.sparkSession, path)
