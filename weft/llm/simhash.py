"""SimHash near-duplicates: exact links between 64-bit fingerprints by tiles.

Distinct fingerprints are sorted by their population counts (of the whole word, its halves, quarters and
bytes) and dealt into groups of equal size. A task compares two groups (exclusive or and bit count
in numpy). Pairs of groups, and inside a task pairs of tiles, are skipped when population counts differ
beyond the radius: the distance of two words is at least the sum, over the parts of one level,
of the differences of the parts' counts. A task returns a
spanning forest of its links, not the links, so dense groups of near copies stay linear.
Components come from alternating star contractions on the written edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, cut, extended, keyed, per_batch, texts_of

SEED = 42
CHUNK = 1 << 16


def fingerprint(text: str, words_per_shingle: int = 4) -> int:
    """The fingerprint as an unsigned number: majority of the bits of the shingles' XXH64."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(words_per_shingle, len(words))
    first = np.concatenate(([0], ends[: len(words) - k])).tolist()
    last = (ends[k - 1 :] - 1).tolist()
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(first[at : at + CHUNK], last[at : at + CHUNK])], np.dtype("<u8"))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""

    def run(ids: list, texts: list[str]) -> dict:
        return {"doc_id": ids, "fp": np.array([fingerprint(t, words_per_shingle) for t in texts], np.uint64).view(np.int64)}

    return per_batch(docs, run, "doc_id long, fp long")


#: Columns of ``part_counts`` by level: the word, its halves, its quarters, its bytes.
LEVELS = (slice(0, 1), slice(1, 3), slice(3, 7), slice(7, 15))


def part_counts(fp: np.ndarray) -> np.ndarray:
    """Population counts of each word, its halves, its quarters and its bytes: 15 columns."""
    by = np.bitwise_count(np.ascontiguousarray(fp, np.dtype("<u8")).view(np.uint8).reshape(-1, 8)).astype(np.int16)
    quarters = by[:, ::2] + by[:, 1::2]
    halves = quarters[:, ::2] + quarters[:, 1::2]
    return np.hstack([halves.sum(axis=1, keepdims=True, dtype=np.int16), halves, quarters, by])


def ordered_tiles(fp: np.ndarray, size: int) -> tuple[np.ndarray, list[slice], np.ndarray, np.ndarray]:
    """An order by part counts, its tiles of at most ``size`` words, and the tiles' least and largest counts."""
    counts = part_counts(fp)
    order = np.lexsort((fp, *(counts[:, c] for c in (13, 11, 9, 7, 5, 3, 1, 0))))
    starts = np.arange(0, len(fp), size)
    tiles = [slice(i, min(i + size, len(fp))) for i in starts.tolist()]
    counts = counts[order]
    return order, tiles, np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """A lower bound for the distance between the words of one tile and those of each other tile."""
    apart = np.maximum(0, np.maximum(low - highs, lows - high))
    return np.max([apart[:, level].sum(axis=1) for level in LEVELS], axis=0)


def links(a: np.ndarray, b: np.ndarray, radius: int, size: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with at most ``radius`` differing bits, a batch per pair of tiles."""
    if not len(a) or not len(b):
        return
    order_a, tiles_a, low_a, high_a = ordered_tiles(a, size)
    order_b, tiles_b, low_b, high_b = ordered_tiles(b, size)
    b_sorted = b[order_b]
    for t, low, high in zip(tiles_a, low_a, high_a):
        rows = order_a[t]
        near = np.flatnonzero(gaps(low, high, low_b, high_b) <= radius)
        if not len(near):
            continue
        mine = a[rows][:, None]
        for k in range(0, len(near), 16):
            at = np.concatenate([np.arange(tiles_b[x].start, tiles_b[x].stop) for x in near[k : k + 16]])
            i, j = np.nonzero(np.bitwise_count(mine ^ b_sorted[at][None, :]) <= radius)
            if len(i):
                yield rows[i], order_b[at[j]]


class Forest:
    """Union-find over positions; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:  # flatten, then drop what is linked already
            flat = self.root[self.root]
            if np.array_equal(flat, self.root):
                break
            self.root = flat
        open_ = flat[i] != flat[j]
        for x, y in zip(i[open_].tolist(), j[open_].tolist()):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.root[max(p, q)] = min(p, q)
                self.edges.append((x, y))


def packed_groups(fps: DataFrame, group_size: int, least_groups: int) -> DataFrame:
    """Written groups (g, low, high, fps): the sorted fingerprints in one cell, and the range of their bit counts."""
    groups = max(1, least_groups, -(-fps.count() // group_size))
    part = lambda shift, mask: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask)))
    order = [F.bit_count("fp"), part(0, 0xFFFFFFFF), part(0, 0xFFFF), part(32, 0xFFFF), F.col("fp")]
    spread = fps.repartitionByRange(groups, *order).select("fp", F.spark_partition_id().alias("g"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, g = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column("fp").to_numpy(zero_copy_only=False))
                g = batch.column("g")[0].as_py()
        if held:
            fp = np.concatenate(held)
            bits = np.bitwise_count(fp.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int32()), "low": pa.array([int(bits.min())], pa.int32()), "high": pa.array([int(bits.max())], pa.int32()), "fps": pa.array([fp.tobytes()], pa.binary())})

    return cut(spread.mapInArrow(pack, "g int, low int, high int, fps binary"))


def near_links(fps: DataFrame, radius: int, group_size: int = 1 << 16) -> DataFrame:
    """Spanning edges (a, b) of the links between distinct fingerprints ``fp``, forest by forest.

    A group travels once to each partner whose population counts are within the radius. Three
    numbers per group of up to ``group_size`` fingerprints reach the driver. ``fp`` is distinct and not NULL; an empty table gives no links.
    """
    spark = fps.sparkSession
    packed = packed_groups(fps, group_size, 3 * spark.sparkContext.defaultParallelism)
    bounds = packed.select("g", "low", "high").orderBy("g").collect()
    g, low, high = (np.array([r[k] for r in bounds], np.int64) for k in range(3))
    first = np.searchsorted(high, low - radius, "left")  # both bounds ascend with g
    last = np.searchsorted(low, high + radius, "right") - 1
    reach = spark.createDataFrame(pd.DataFrame({"g": g, "k": np.arange(len(g)), "first": first, "last": last}), "g int, k long, first long, last long")
    partner = F.explode(F.sequence("first", "last")).alias("other")
    dealt = packed.select("g", "fps").join(reach, "g").select("fps", "k", partner).select(F.least("k", "other").alias("x"), F.greatest("k", "other").alias("y"), "fps")
    return dealt.groupBy("x", "y").applyInPandas(lambda pdf: compare(pdf, radius), "a long, b long")


def compare(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """The forest of one task: one group with itself, or two groups with each other."""
    parts = [np.frombuffer(f, np.int64) for f in pdf["fps"]]
    shift = 0 if len(parts) == 1 else len(parts[0])
    forest = Forest(shift + len(parts[-1]))
    for i, j in links(parts[0].view(np.uint64), parts[-1].view(np.uint64), radius):
        forest.add(i, j + shift)
    words = parts[0] if len(parts) == 1 else np.concatenate(parts)
    edges = words[np.array(forest.edges, np.int64).reshape(-1, 2)]
    return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of ``edges`` (a, b), which may be structs.

    Large-star and small-star contractions on the written edges until they are stars; a round is two
    aggregations and two joins, whose hot keys Spark splits. Repeated edges count once, an edge from a node to itself not at all; no edges
    give no rows.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        then = cut(small)
        check = then.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        was = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if check == was:
            return then.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = then


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints of at most ``radius`` differing bits are linked; a component is named by its
    smallest id. NULL texts are empty: their fingerprint is zero, linked like any other. A NULL id never
    names a component unless no other id is in it (then NULL). Repeated rows give repeated results;
    an empty table gives none. Other columns are not read.
    """
    found = rooted(df, id_col, text_col, words_per_shingle, radius)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def rooted(df: DataFrame, id_col: str, text_col: str, words_per_shingle: int, radius: int) -> DataFrame:
    """(doc_id, fp, root, component_id) of each row; the root tells components apart that one id names."""
    prints = cut(fingerprints(keyed(df, id_col, text_col), words_per_shingle))
    # a node is its smallest id (none counts as the largest) and its fingerprint: the smallest node names the component
    node = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "fp")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")).select("fp", node.alias("node")))
    links = near_links(nodes.select("fp"), radius)
    ends = links.join(nodes.toDF("a", "na"), "a").join(nodes.toDF("b", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    found = components(ends).withColumnRenamed("node", "linked")
    named = nodes.join(found, F.col("node.fp") == F.col("linked.fp"), "left").select("fp", F.coalesce("component", "node").alias("top"))
    of_print = cut(named.select("fp", F.col("top.fp").alias("root"), F.col("top.least_id").alias("component_id")))
    return prints.join(of_print, "fp")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``df`` that name their component, one of each, with all their columns; rows without an id stay.

    Only the ids that go are joined, by a broadcast if their size allows it. Ids that several rows share
    are decided row by row, by the fingerprint.
    """
    groups = cut(rooted(df, id_col, text_col, words_per_shingle, radius).where("doc_id is not null"))
    ids = cut(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("doc_id") != F.col("component_id")).alias("gone")))
    named = lambda rows: cut(rows.select(F.col("doc_id").alias("weft_id")))
    same = col(id_col).cast("long") == F.col("weft_id")
    once = df.join(named(ids.where("rows > 1 or gone")), same, "left_anti")
    several = named(ids.where("rows > 1"))
    if not several.limit(1).count():
        return once
    first = groups.where("doc_id = component_id").groupBy("root", F.col("doc_id").alias("weft_id")).agg(F.min("fp").alias("weft_least"))
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> dict:
        return {"weft_fp": np.array([fingerprint(t, words_per_shingle) for t in texts_of(batch.column(at))], np.uint64).view(np.int64)}

    shared = extended(df.join(several, same, "left_semi"), text_col, run, {"weft_fp": "long"})
    stays = cut(first.select("weft_id", "weft_least"))
    again = shared.join(stays, same & (F.col("weft_fp") == F.col("weft_least")), "left_semi")
    order = F.row_number().over(W.partitionBy(col(id_col), "weft_fp").orderBy(col(text_col)))
    return once.unionByName(again.withColumn("weft_repeat", order).where("weft_repeat = 1").drop("weft_repeat", "weft_fp"))
