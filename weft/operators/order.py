"""Ordered positions that hold when one key owns a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from weft.session import cut


def positions(df: DataFrame, keys: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """1-based position of each row within ``keys`` by ``order``, without one task per key.

    Rows are range-partitioned by (keys, order), so a hot key spreads over many partitions.
    The partition number is stored before it is used (a recomputed range partitioning could
    cut elsewhere). Row counts per (key, partition) give each partition its offset; the window
    that adds them up sees at most one row per partition and key.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy("_part", *keys).orderBy(*order)
    rows = ranged.withColumn("_rn", F.row_number().over(inside))
    cond = rows["_part"].eqNullSafe(offsets["_part"])
    for k in keys:
        cond = cond & rows[k].eqNullSafe(offsets[k])
    joined = rows.join(offsets, cond)
    return joined.select(
        *[rows[c] for c in df.columns], (F.col("_rn") + F.col("_before")).cast("bigint").alias(out)
    )


def ordered_chunks(
    df: DataFrame, keys: list[str], order: list[str], value: str, size: int = 10_000, out: str = "items"
) -> DataFrame:
    """Per key the values in order, as arrays of at most ``size`` entries: (keys, part, items)."""
    pos = positions(df, keys, order, "_pos").withColumn("part", F.floor((F.col("_pos") - 1) / size).cast("bigint"))
    return (
        pos.groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", F.col(value).alias("_v")))).alias("_s"))
        .select(*keys, "part", F.transform("_s", lambda s: s["_v"]).alias(out))
    )


def before(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, tops: dict[str, str] | None = None) -> DataFrame:
    """``df`` with sums and maxima (result: column) over the rows that come before each one within ``keys`` by ``order``.

    Without such rows a sum is 0 and a maximum NULL. Like ``positions``: a key may own any share of the rows; every
    range of rows hands on one total per key.
    """
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    every = [(out, col, F.sum) for out, col in (sums or {}).items()] + [(out, col, F.max) for out, col in (tops or {}).items()]
    inside = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ahead = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_part", *keys).agg(*(fn(col).alias(out) for out, col, fn in every))
    carried = totals.select("_part", *keys, *(fn(out).over(ahead).alias(f"_{out}") for out, _, fn in every))
    rows = ranged.select("*", *(fn(col).over(inside).alias(out) for out, col, fn in every)).join(carried, ["_part", *keys])
    found = {out: F.coalesce(out, F.lit(0)) + F.coalesce(f"_{out}", F.lit(0)) for out in sums or {}} | {out: F.greatest(out, f"_{out}") for out in tops or {}}
    return rows.select(*df.columns, *(c.alias(out) for out, c in found.items()))
