"""Pairs of rows that share a key, where one key may be in any share of the rows.

The rows of a key are cut into numbered bands of about BAND rows, and every two bands of it meet under a key of their own. So
no key of the join has more than two bands of rows, and every pair is met once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weft.session import cut

#: Rows of a band.
BAND = 4096


def banded(rows: DataFrame, key: str, item: str, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """The left and right copies of the rows, with the bands (_p, _q), _p <= _q, under which they meet.

    Only keys of more than one band are looked up; a row of such a key is copied once per band.
    """
    large = cut(rows.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count(F.lit(1)) / band).alias("_bands")).filter("_bands > 1"))
    known = rows.join(large, F.col(key) == F.col("_key"), "left").drop("_key").withColumn("_bands", F.coalesce("_bands", F.lit(1).cast("long")))
    own = known.withColumn("_own", F.pmod(F.xxhash64(item), F.col("_bands")))
    left = own.select(*rows.columns, F.col("_own").alias("_p"), F.explode(F.sequence("_own", F.col("_bands") - 1)).alias("_q"))
    right = own.select(*rows.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_own"))).alias("_p"), F.col("_own").alias("_q"))
    return left, right


def band_pairs(rows: DataFrame, key: str, item: str, same: bool = False, band: int = BAND) -> DataFrame:
    """(key, i, j, and x_i, x_j of every other column): all pairs of rows of one key with i < j, those of an item with itself too if ``same``.

    An item is in one row of a key at most.
    """
    others = [c for c in rows.columns if c not in (key, item)]
    left, right = banded(rows, key, item, band)
    a = left.select(key, "_p", "_q", F.struct(F.col(item).alias("at"), *others).alias("_a"))
    b = right.select(key, "_p", "_q", F.struct(F.col(item).alias("at"), *others).alias("_b"))
    within = F.col("_a.at") <= F.col("_b.at") if same else F.col("_a.at") < F.col("_b.at")
    met = a.join(b, [key, "_p", "_q"]).filter((F.col("_p") < F.col("_q")) | within)
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")  # structs compare by their item first
    return met.select(key, low.alias("_l"), high.alias("_h")).select(
        key, F.col("_l.at").alias("i"), F.col("_h.at").alias("j"), *(F.col(f"{s}.{c}").alias(f"{c}_{x}") for c in others for s, x in (("_l", "i"), ("_h", "j")))
    )
