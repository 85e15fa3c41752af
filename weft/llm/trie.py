"""The trie of conversation beginnings, with counts per node.

A beginning is known by a 128-bit digest: the exclusive or of a hash of every turn and its place, which
can be taken in parts, so that a conversation of any length is cut into chunks of turns that any task may
hold. An Arrow batch of chunks is a shard. Each shard enumerates its distinct digests, gives them the slots of a
minimal perfect hash table, scatters its numbers into flat arrays by slot, and adds them up from the deepest
nodes to the root through an array of parents' slots. Spark adds up the shards' rows per digest.

First the shards count members. Every node then belongs to its smallest member, and only there do its own
numbers (tokens saved, leaf or not) enter the second round, so that adding up shards counts each node once.
What later chunks of a conversation hold is handed to the last node of the chunk before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.order import positions

from .common import col, cut, small_batches
from .slots import SlotTable, mix

#: Turns of a chunk.
CHUNK = 1024
#: Conversations that share a beginning: those of one block take their first turns from the block's first.
BLOCK, HEADS = 20, 4
#: Parents with more children than this, and than one in 10,000 of all nodes, are joined by broadcast (so 10,000 at most).
MANY_CHILDREN, MOST_HEAVY = 50_000, 10_000
#: Ids written into one string at a time.
IDS = 4096

KEY = ["k1", "k2"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
NODE = "k1 long, k2 long, depth long, p1 long, p2 long, t1 long, t2 long, words long, n_convs long, conv_id long"


def arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def turn_digests(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, t1, t2, words): 128 bits of SHA-256 of role and text (its bytes in order as two longs), words of the text."""
    text = lambda name: F.coalesce(col(name).cast("string"), F.lit("")).cast("binary")
    rows = df.select(col(id_col).cast("long").alias("conv_id"), col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv_id IS NOT NULL")
    schema = arrow("conv_id long, turn long, t1 long, t2 long, words long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums = [hashlib.sha256(b"%d:%b%b" % (len(r), r, t)).digest() for r, t in zip(batch.column("role").to_pylist(), texts)]
            halves = np.frombuffer(b"".join(s[:16] for s in sums), ">u8").astype(np.uint64).reshape(-1, 2) ^ np.uint64(1 << 63)
            words = [len(t.split()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *(pa.array(halves[:, k].view(np.int64)) for k in (0, 1)), pa.array(words, pa.int64())], schema=schema)

    return small_batches(rows).mapInArrow(run, "conv_id long, turn long, t1 long, t2 long, words long")


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after the first h turns of each conversation were replaced by those of its block's first.

    ``turns``: conv_id, depth (from 1), t1, t2, words; ``conversations``: conv_id. No join has more than CHUNK rows a key on
    the side of the turns.
    """
    numbered = cut(positions(df.withColumn("tie", F.monotonically_increasing_id()), ["conv_id"], ["turn", "t1", "t2", "tie"]).drop("turn", "tie"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    known = cut(numbered.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base")))
    firsts = known.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = cut(known.join(firsts, "base", "left").select("conv_id", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("m")))
    part = F.floor((F.col("pos") - 1) / CHUNK)
    spread = known.where("n > h").select("conv_id", "h", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("part"))
    own = numbered.withColumn("part", part).join(spread, ["conv_id", "part"]).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "t1", "t2", "words")
    heads = numbered.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    heads = known.where("m > 0").select("conv_id", "base", "h").join(heads, "base").where("pos <= h")
    return own.unionByName(heads.select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "words")), known.select("conv_id")


class Chunks:
    """The turns of a batch of chunks as flat arrays, with the digests of the beginnings they end."""

    def __init__(self, batch: pa.RecordBatch, carried: bool = True):
        seq = batch.column("seq")
        flat = seq.flatten()
        self.sizes = np.diff(seq.offsets.to_numpy())
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.depth, self.t1, self.t2, self.words = (flat.field(i).to_numpy() for i in range(4))
        self.k1, self.k2 = (self.beginnings(h) for h in self.hashes())
        if carried:
            for k, name in ((self.k1, "c1"), (self.k2, "c2")):
                k ^= batch.column(name).to_numpy().view(np.uint64)[self.row]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        place = mix(self.depth.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        a, b = self.t1.view(np.uint64), self.t2.view(np.uint64)
        return mix(a + mix(b ^ place)), mix(b + mix(a + place))

    def beginnings(self, h: np.ndarray) -> np.ndarray:
        """The exclusive or of the hashes from the start of the chunk on."""
        total = np.bitwise_xor.accumulate(h) if len(h) else h
        before = np.concatenate([np.zeros(1, np.uint64), total])[self.starts]
        return total ^ before[self.row]

    def parents(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The digest before each turn."""
        out = []
        for k, name in ((self.k1, "c1"), (self.k2, "c2")):
            p = np.concatenate([np.zeros(1, np.uint64), k[:-1]]) if len(k) else k.copy()
            p[self.starts] = batch.column(name).to_numpy().view(np.uint64)
            out.append(p)
        return out[0], out[1]


def distinct(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """The index of one row of each key."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[new]


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """(conv_id, chunk, size, x1, x2): turns of each chunk and the exclusive or of their hashes."""
    schema = arrow("conv_id long, chunk long, size long, x1 long, x2 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Chunks(batch, carried=False)
            last = c.starts + c.sizes - 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(c.sizes.astype(np.int64)), *(pa.array(k[last].view(np.int64)) for k in (c.k1, c.k2))], schema=schema)

    return small_batches(chunks).mapInArrow(run, "conv_id long, chunk long, size long, x1 long, x2 long")


def members(shards: DataFrame) -> DataFrame:
    """Node rows per shard: digest, depth, parent's digest, last turn, and over the shard's members their number and smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Chunks(batch)
            p1, p2 = c.parents(batch)
            one = distinct(c.k1, c.k2)
            table = SlotTable(c.k1[one], c.k2[one])
            slot = table.slots(c.k1, c.k2)
            count, least = np.bincount(slot, minlength=len(table)), np.full(len(table), np.iinfo(np.int64).max)
            np.minimum.at(least, slot, batch.column("conv_id").to_numpy()[c.row])
            seen = {}
            for name, values in (("depth", c.depth), ("p1", p1), ("p2", p2), ("t1", c.t1), ("t2", c.t2), ("words", c.words)):
                seen[name] = np.empty(len(table), values.dtype)
                seen[name][slot] = values
                if (seen[name][slot] != values).any():
                    raise ValueError("two beginnings with one digest")
            seen |= {"k1": table.first, "k2": table.second, "n_convs": count, "conv_id": least}
            yield pa.RecordBatch.from_arrays([pa.array(seen[f.name].view(np.int64)) for f in arrow(NODE)], schema=arrow(NODE))

    return small_batches(shards).mapInArrow(run, NODE)


def node_table(partial: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node, written. Rows of shards that disagree on what a digest stands for end the job."""
    same = ["depth", "p1", "p2", "t1", "t2", "words"]
    root = ids.agg(*(F.lit(0).cast("long").alias(c) for c in KEY), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words")).where("n_convs > 0")
    nodes = partial.groupBy(*KEY).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(F.struct(*same)).alias("low"), F.max(F.struct(*same)).alias("high"))
    agreed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("two beginnings with one digest")))
    nodes = nodes.withColumn("s", agreed).select(*KEY, "n_convs", "conv_id", "s.depth", "s.words", "s.p1", "s.p2")
    return cut(nodes.unionByName(root, allowMissingColumns=True))


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_children and parent_conv_id, written.

    A parent with very many children is looked up in a broadcast table of at most MOST_HEAVY rows; what is left has a
    bounded number of children a key.
    """
    children = nodes.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = cut(nodes.join(children, KEY, "left").fillna(0, ["n_children"]))
    many = max(MANY_CHILDREN, counted.count() // MOST_HEAVY)
    parent = counted.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > many).alias("heavy"))
    heavy = parent.where("heavy").drop("heavy").withColumnRenamed("parent_conv_id", "heavy_id")
    marked = counted.join(F.broadcast(heavy), ["p1", "p2"], "left")
    under_heavy = marked.where("heavy_id IS NOT NULL").withColumnRenamed("heavy_id", "parent_conv_id")
    light = marked.where("heavy_id IS NULL AND p1 IS NOT NULL").drop("heavy_id").join(parent.where("NOT heavy").drop("heavy"), ["p1", "p2"], "left")
    root = counted.where("p1 IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return cut(under_heavy.unionByName(light).unionByName(root))


def subtree_sums(shards: DataFrame, chunk: int) -> DataFrame:
    """(k1, k2, n_leaves, saved_tokens) per node and shard. ``shards`` also have the chunk's ``own`` nodes (depth, saved, leaf) and what ``later`` chunks hold."""
    ddl = "k1 long, k2 long, n_leaves long, saved_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Chunks(batch)
            p1, p2 = c.parents(batch)
            zero = np.zeros(1, np.uint64)  # the root stands in every shard
            k1, k2 = np.concatenate([c.k1, zero]), np.concatenate([c.k2, zero])
            depth = np.concatenate([c.depth, [0]])
            one = distinct(k1, k2)
            table = SlotTable(k1[one], k2[one])
            slot = table.slots(c.k1, c.k2)
            level, parent = np.zeros(len(table), np.int64), np.full(len(table), -1, np.int64)
            level[table.slots(k1, k2)] = depth
            inside = (c.depth - 1) % chunk != 0
            inside |= c.depth == 1
            parent[slot[inside]] = table.slots(p1[inside], p2[inside])
            leaves, saved = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
            own = batch.column("own")
            flat = own.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(own.offsets.to_numpy()))
            at = slot[c.starts[row] + (flat.field(0).to_numpy() - 1) % chunk]
            last = slot[c.starts + c.sizes - 1]
            for total, i, name in ((saved, 1, "later_saved"), (leaves, 2, "later_leaves")):
                np.add.at(total, at, flat.field(i).to_numpy())
                np.add.at(total, last, batch.column(name).to_numpy())
            order = np.argsort(-level, kind="stable")
            order = order[level[order] > 0]
            for same in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
                same = same[parent[same] >= 0]
                for total in (leaves, saved):
                    np.add.at(total, parent[same], total[same])
            keep = (leaves != 0) | (saved != 0)
            yield pa.RecordBatch.from_arrays([pa.array(v[keep].view(np.int64)) for v in (table.first, table.second, leaves, saved)], schema=arrow(ddl))

    return small_batches(shards).mapInArrow(run, ddl)


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of rows (k1, k2, conv_id): the hash of each node's ids in ascending order, comma-joined.

    Ranges of (node, id) are joined to strings of up to IDS ids, wherever they lie; a hash runs over its
    text in order, so a node's strings then meet in one task, which holds one of them at a time.
    """
    ddl = "k1 long, k2 long, first long, ids string"
    schema, result = arrow(ddl), arrow("k1 long, k2 long, ends_sha256 string")
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids = (batch.column(i).to_numpy() for i in range(3))
            new = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
            edges = sorted({*new.tolist(), *(at for i, j in zip(new, [*new[1:], len(k1)]) for at in range(i, j, IDS))})
            text = list(map(str, ids.tolist()))
            joined = [",".join(text[i:j]) for i, j in zip(edges, [*edges[1:], len(k1)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(v[edges]) for v in (k1, k2, ids)), pa.array(joined, pa.string())], schema=schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (k1, k2) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(result.names, r)) for r in done], schema=result)
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(result.names, (*key, state.hexdigest())))], schema=result)

    strings = ends.repartitionByRange(parts, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(join, ddl)
    return strings.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn`` (NULL first), ties by the SHA-256 of role and text; repeated rows are turns of their
    own. NULL role or text is empty; rows without a conversation are left out, and a table without any gives no node.
    Other columns are not read.
    """
    turns, ids = rebuilt(turn_digests(df, id_col, turn_col, role_col, text_col))
    part = F.floor((F.col("depth") - 1) / chunk).alias("chunk")
    seq = F.array_sort(F.collect_list(F.struct("depth", "t1", "t2", "words"))).alias("seq")
    chunks = cut(turns.groupBy("conv_id", part).agg(seq))
    totals = cut(chunk_totals(chunks))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv_id", "chunk", *(F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"c{k}") for k in (1, 2)))
    shards = cut(chunks.join(carry, ["conv_id", "chunk"]))
    nodes = with_parents(node_table(members(shards), ids))

    saved, leaf = (F.col("n_convs") - 1) * F.col("words"), (F.col("n_children") == 0).cast("long")
    own = nodes.where("depth > 0").withColumn("saved", saved).withColumn("leaf", leaf)
    own = own.groupBy("conv_id", part).agg(F.collect_list(F.struct("depth", "saved", "leaf")).alias("own"), F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    after = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(1, Window.unboundedFollowing)
    held = totals.select("conv_id", "chunk").join(own, ["conv_id", "chunk"], "left")
    held = held.select("conv_id", "chunk", F.coalesce("own", F.array().cast("array<struct<depth:long,saved:long,leaf:long>>")).alias("own"),
                       *(F.coalesce(F.sum(v).over(after), F.lit(0)).alias(n) for v, n in (("s", "later_saved"), ("l", "later_leaves"))))
    held = held.where("size(own) > 0 OR later_saved > 0 OR later_leaves > 0")
    sums = subtree_sums(shards.join(held, ["conv_id", "chunk"]), chunk).groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    ends = totals.groupBy("conv_id").agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"))
    ends = cut(ids.join(ends, "conv_id", "left").select(F.coalesce("k1", F.lit(0)).alias("k1"), F.coalesce("k2", F.lit(0)).alias("k2"), "conv_id"))
    done = nodes.join(sums, KEY, "left").join(end_digests(ends), KEY, "left")
    # the root of conversations without turns is its own leaf
    leaves = F.coalesce("n_leaves", (F.col("n_children") == 0).cast("long"))
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
