"""Exact deduplication with an extendible-hash index on shared files, in DataFrame operations only.

1. Every text gets a 64-bit key. ``chains`` groups by (key, text): Spark compares the bytes of
   equal keys, and each map task reduces its copies to one row before the shuffle, so a group of
   any size reaches its owner as one row per map task. Distinct texts with one key are a chain.
2. ``directory`` doubles until no bucket of distinct keys is overfull: a bucket is the smallest
   key prefix whose count fits the capacity, so only overfull buckets split.
3. The index (bucket, key, digest, id that stays, size of the group) is written in bucket order to
   the shared folder; owner tasks take contiguous ranges of buckets.
4. Documents find the bucket of their key in the directory and probe the index with bucket, key and digest.
   The digest selects the entry of the chain: the entries
   were made by comparing bytes, and the index refuses two entries of one chain with one digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, cut, keyed

#: Distinct keys a bucket may hold before it splits.
CAPACITY = 100_000
#: What names a bucket: the number of leading bits of its keys, and these bits.
BUCKET = ["depth", "prefix"]


def key64(text: Column) -> Column:
    return F.xxhash64(text)


def keys(docs: DataFrame, key: Column) -> DataFrame:
    """(doc_id, key, digest) of every row, without its text."""
    return docs.select("doc_id", key.alias("key"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def chains(docs: DataFrame, key: Column) -> DataFrame:
    """One row per distinct text: its key, digest, the largest doc_id and the number of rows."""
    groups = docs.groupBy(key.alias("key"), "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.select("key", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "keep_id", "group_size")


def directory(entries: DataFrame, capacity: int) -> DataFrame:
    """(prefix, depth): leaf buckets of the directory over the distinct keys of ``entries``.

    Global depth doubles as long as one bucket is overfull. A round needs the counts of
    the overfull buckets only; the copies of one key count once and can't force a split.
    """
    cells = entries.select("key").distinct()
    done: DataFrame | None = None
    depth, over = 0, cells
    while True:
        counted = cut(over.groupBy(prefix_of(F.col("key"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n")))
        fits = counted.where((F.col("n") <= capacity) | F.lit(depth == 63)).select("prefix", F.lit(depth).alias("depth"), "n")
        done = fits if done is None else done.unionByName(fits)
        full = counted.where(F.col("n") > capacity)
        worst = full.agg(F.max("n")).first()[0] if depth < 63 else None
        if worst is None:
            return done
        step = max(1, (int(worst - 1) // capacity).bit_length())
        over = over.join(full.select(F.col("prefix").alias("p")), prefix_of(F.col("key"), depth) == F.col("p"), "left_semi")
        depth = min(63, depth + step)


def prefix_of(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def index(docs: DataFrame, key: Column, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The written index and its directory. Two texts of one chain with one digest are refused."""
    entries = cut(chains(docs, key))
    leaves = cut(directory(entries, capacity))
    chain = entries.groupBy("key").agg(F.count(F.lit(1)).alias("chain"), F.count_distinct("digest").alias("digests"))
    refuse = F.when(F.col("digests") < F.col("chain"), F.raise_error(F.lit("two texts share key and digest"))).otherwise(F.col("chain"))
    chained = entries.join(chain.select("key", refuse.alias("chain")), "key")
    placed = in_buckets(chained, leaves).select(*BUCKET, "key", "digest", "keep_id", "group_size", "chain")
    start = F.expr("shiftleft(prefix, 63 - depth)")  # unsigned, so bucket order is key order
    return cut(placed.repartitionByRange(start, *BUCKET, "key").sortWithinPartitions(start, *BUCKET, "key", "digest")), leaves


def in_buckets(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with the bucket of their ``key`` in the directory (depth, prefix); a key without a bucket is in no row.

    A key is looked up by its prefix of every depth that occurs; of these exactly one is a leaf.
    """
    depths = [r[0] for r in leaves.select("depth").distinct().orderBy("depth").collect()]  # 64 numbers at most
    prefixes = F.array(*[F.struct(F.lit(d).alias("depth"), prefix_of(F.col("key"), d).alias("prefix")) for d in depths or [0]])
    if len(depths) < 2:  # one depth: every prefix of it that occurs is a leaf
        cell = prefixes[0]
        found = rows.withColumns({"depth": cell["depth"], "prefix": cell["prefix"]})
    else:
        found = rows.withColumn("at", F.explode(prefixes)).select(*rows.columns, "at.depth", "at.prefix")
    return found.join(leaves.select(*BUCKET), BUCKET, "left_semi")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; NULL counts as empty. The largest id of a group stays.
    A NULL id stays only where the whole group has none (keep_id NULL). Of rows that repeat both id
    and text, one is kept. An empty table gives no rows; other columns are not read.
    """
    docs = keyed(df, id_col, text_col)
    key = key64(F.col("text")) if key is None else key
    found = probed(keys(docs, key), *index(docs, key, capacity))
    repeat = F.row_number().over(W.partitionBy("doc_id", "digest").orderBy("keep_id"))
    return found.withColumn("repeat", repeat).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("repeat") == 1)).alias("kept"), F.col("digest").alias("text_sha256")
    )


def probed(rows: DataFrame, entries: DataFrame, leaves: DataFrame) -> DataFrame:
    """(doc_id, key, digest) with keep_id and group_size from the index, by way of the directory."""
    probe = [*BUCKET, "key", "digest"]
    return in_buckets(rows, leaves).join(entries.select(*probe, "keep_id", "group_size"), probe)


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Only the ids that go are joined, so the texts are not shuffled where those are few enough for a
    broadcast of checked size. Ids that several rows share (and NULL ids) are decided row by row; of
    rows that repeat id and text one stays. NULL texts equal empty ones; an empty table gives no rows.
    """
    groups = cut(exact_groups(df, id_col, text_col))
    ids = cut(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.bool_and("kept").alias("kept")))
    shared = (F.col("rows") > 1) | F.col("doc_id").isNull()
    named = lambda rows: cut(rows.select(F.col("doc_id").alias("weft_id")))
    same = col(id_col).cast("long").eqNullSafe(F.col("weft_id"))
    once = df.join(named(ids.where(shared | ~F.col("kept"))), same, "left_anti")
    several = named(ids.where(shared))
    if not several.limit(1).count():
        return once
    digest = F.sha2(F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    stays = cut(groups.where("kept").select(F.col("doc_id").alias("weft_id"), F.col("text_sha256").alias("weft_digest")))
    again = df.join(several, same, "left_semi").join(stays, same & (digest == F.col("weft_digest")), "left_semi")
    first = F.row_number().over(W.partitionBy(col(id_col), digest).orderBy(col(id_col)))
    return once.unionByName(again.withColumn("weft_repeat", first).where("weft_repeat = 1").drop("weft_repeat"))
