"""All pairs, distances, radius joins and summaries over blocks.

Items are cut into blocks by a hash (or by a value that bounds the distance from below).
Each unordered pair of blocks is one task, which goes through tiles of ``block_rows`` × ``block_rows`` items; the
number of blocks stays while they fit a task's memory, so the copies that travel grow with the items, not with their square. What leaves a task is what was asked for:
pairs within a distance, the k nearest per item, or one partial sum per item and block; the
complete pair table is written only when the caller sets neither.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from weft.functions.kernels import BOTH, GRIDS, KERNELS, WITHIN, euclidean_nearest, stack

PAYLOAD = {
    "jaccard_set": ["words"],
    "order": ["courses", "pos", "n_sem"],
    "order_share": ["courses", "pos", "n_sem"],
    "path_emd": ["courses", "pos", "n_sem"],
    "path_energy": ["courses", "pos", "n_sem"],
}

# Metrics whose value depends on which of the two items has the lower key.
ORIENTED = {"order_share"}


def block_count(n: int, block_rows: int, cores: int) -> int:
    """Enough blocks that a task holds at most ``block_rows`` items a side, and all cores work."""
    spread = int(np.ceil(np.sqrt(2 * cores)))
    return max(1, int(np.ceil(n / block_rows)), min(spread, int(np.ceil(n / 32))))


def with_blocks(items: DataFrame, key: str, block_rows: int, bound: Column | None = None, reach: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The left and right copies of the items, each row tagged with its block pairs (gl, gr).

    With ``bound`` (a number whose difference never exceeds the distance) blocks are value
    ranges and only block pairs within ``reach`` meet; a range that holds too many rows, such
    as one repeated value, is divided further by hash.
    """
    left, right, _ = tagged_blocks(items, key, block_rows, bound, reach)
    return left, right


#: Blocks that a table is cut into while each has at most LARGE rows: a row is copied once per block.
BLOCKS, LARGE = 16, 200_000
#: The same for items that hold more than a vector.
LARGE_ITEMS = 20_000
#: Rows that a task gathers before it folds them.
FOLDED = 1_000_000


def large_blocks(n: int, block_rows: int, large: int) -> int:
    """Rows of the blocks that are sent: the items in BLOCKS blocks, of at most ``large`` rows and at least ``block_rows``."""
    return max(block_rows, min(large, -(-n // BLOCKS)))


def tagged_blocks(items: DataFrame, key: str, block_rows: int, bound: Column | None, reach: float | None, large: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """``with_blocks``, and whether the copies have the column ``_m`` with the bound. With ``large`` the blocks grow with the items (``large_blocks``)."""
    spark = items.sparkSession
    cores = spark.sparkContext.defaultParallelism
    bounded = bound is not None and reach is not None
    if not bounded:
        n = items.count()
        sent = block_rows if large is None else large_blocks(n, block_rows, large)
        subs, edges = [block_count(n, sent, cores)], []
        tagged = items.withColumn("_lo", F.lit(0)).withColumn("_hi", F.lit(0)).withColumn("_b", F.lit(0))
    else:
        valued = items.withColumn("_m", bound.cast("double")).filter(F.col("_m").isNotNull() & ~F.isnan("_m"))
        n = valued.count()
        sent = block_rows if large is None else large_blocks(n, block_rows, large)
        ranges = min(1000, block_count(n, sent, cores) * (2 if large is None else 1))
        quantiles = [i / ranges for i in range(1, ranges)]
        got = valued.agg(F.percentile_approx("_m", quantiles, 10_000)).first()[0] if quantiles and n else []
        edges = sorted(set(got or []))
        edge_col = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")

        def block_of(x: Column) -> Column:
            return F.size(F.filter(edge_col, lambda e: e <= x))

        tagged = (
            valued.withColumn("_b", block_of(F.col("_m")))
            .withColumn("_lo", block_of(F.col("_m") - F.lit(float(reach) + 1e-9)))
            .withColumn("_hi", block_of(F.col("_m") + F.lit(float(reach) + 1e-9)))
        )
        sizes = dict(tagged.groupBy("_b").count().collect())  # one row per block
        subs = [max(1, int(np.ceil(sizes.get(b, 0) / (sent if large is None else 2 * sent)))) for b in range(len(edges) + 1)]
        # all rows of two blocks that meet are sent to them: their tiles are checked by themselves
    starts = np.concatenate([[0], np.cumsum(subs)]).astype(int)
    start = F.array(*[F.lit(int(s)) for s in starts])
    width = F.array(*[F.lit(int(s)) for s in subs])
    own = F.get(start, F.col("_b")) + F.pmod(F.xxhash64(key), F.get(width, F.col("_b")).cast("bigint")).cast("int")
    tagged = tagged.withColumn("_g", own)
    last = F.get(start, F.col("_hi") + 1) - 1
    first = F.get(start, F.col("_lo"))
    kept = bounded and large is not None
    cols = [F.col(c) for c in items.columns] + ([F.col("_m")] if kept else [])
    left = tagged.select(*cols, F.col("_g").alias("gl"), F.explode(F.sequence("_g", last)).alias("gr"))
    right = tagged.select(*cols, F.explode(F.sequence(first, F.col("_g"))).alias("gl"), F.col("_g").alias("gr"))
    return left, right, kept


def tiles(rows: pd.DataFrame, key: str, block_rows: int) -> list[pd.DataFrame]:
    """A block in tiles of at most ``block_rows`` rows, along the bound if there is one; each sorted by key."""
    rows = rows.sort_values("_m" if "_m" in rows.columns else key, kind="stable")
    return [rows.iloc[at : at + block_rows].sort_values(key) for at in range(0, len(rows), block_rows)]


def block_tasks(
    items: DataFrame, key: str, fn: Callable, schema: str, block_rows: int = 1000, bound=None, reach=None, large: int = LARGE, fold: Callable | None = None,
    prepare: Callable | None = None,
) -> DataFrame:
    """Run ``fn(left, right, same)`` on every pair of tiles of ``block_rows`` items; both frames are sorted by key.

    What travels are larger blocks (``large_blocks``), so that a row is copied about BLOCKS times however many
    rows there are; the task of two blocks goes through the pairs of their tiles and hands on each result by itself,
    or, with ``fold`` (rows → fewer rows that stand for them), what is left of all of them. With ``prepare`` the function gets
    what it makes of a tile's frame, once per tile.
    """
    left, right, bounded = tagged_blocks(items, key, block_rows, bound, reach, large)
    # a block that meets itself is sent once
    both = left.withColumn("_side", F.lit(0)).unionByName(right.filter("gl <> gr").withColumn("_side", F.lit(1)))

    def ready(rows: pd.DataFrame) -> list[tuple]:
        """The tiles with the lowest and highest bound of each."""
        cut_up = tiles(rows, key, block_rows)
        return [(x if prepare is None else prepare(x), *((x["_m"].min(), x["_m"].max()) if bounded else (0, 0))) for x in cut_up]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        same = bool(rows["gl"].iloc[0] == rows["gr"].iloc[0])
        a = ready(rows[rows["_side"] == 0])
        b = a if same else ready(rows[rows["_side"] == 1])
        del rows
        made: list[pd.DataFrame] = []
        size, limit = 0, FOLDED
        for i, (x, low, high) in enumerate(a):
            for j in range(i if same else 0, len(b)):
                y, least, most = b[j]
                if bounded and max(low - most, least - high) > reach + 1e-9:
                    continue
                found = fn(x, y, same and i == j)
                if not len(found):
                    continue
                if fold is None:
                    yield found
                    continue
                made.append(found)
                size += len(found)
                if size > limit:
                    made = [fold(pd.concat(made))]
                    size = len(made[0])
                    limit = max(FOLDED, 2 * size)
        if made:
            yield fold(pd.concat(made))

    return both.groupBy("gl", "gr").applyInPandas(task, schema)


def run_blocks(
    items: DataFrame, key: str, metric, emit: Callable, schema: str, block_rows: int = 1000, bound=None, reach=None, fold: Callable | None = None, within: float | None = None
) -> DataFrame:
    """Apply a kernel to every pair of tiles and ``emit`` rows from (left keys, right keys, D, same).

    Where only distances of at most ``within`` count, some kernels (``WITHIN``) give infinity for what a bound rules out.
    """
    kernel = KERNELS[metric] if isinstance(metric, str) else metric
    payload = PAYLOAD.get(metric, ["v"]) if isinstance(metric, str) else [c for c in items.columns if c != key]
    oriented = isinstance(metric, str) and metric in ORIENTED
    if within is not None and isinstance(metric, str) and metric in WITHIN:
        kernel = partial(WITHIN[metric], within=within)

    def columns(tile: pd.DataFrame) -> tuple[np.ndarray, dict]:
        held = {c: tile[c].to_numpy() for c in payload}
        if isinstance(metric, str) and metric in GRIDS:
            held["grid"] = GRIDS[metric](held)
        return tile[key].to_numpy(), held

    def fn(a: tuple[np.ndarray, dict], b: tuple[np.ndarray, dict], same: bool) -> pd.DataFrame:
        (ka, x), (kb, y) = a, b
        if oriented:
            d = np.where(ka[:, None] <= kb[None, :], *BOTH[metric](x, y))
        else:
            d = kernel(x, y)
        return emit(ka, kb, d, same)

    return block_tasks(items.select(key, *payload), key, fn, schema, block_rows, bound, reach, LARGE if payload == ["v"] else LARGE_ITEMS, fold, columns)


def key_type(items: DataFrame, key: str) -> str:
    return items.schema[key].dataType.simpleString()


def pairwise(
    items: DataFrame, key: str, metric, max_dist: float | None = None, block_rows: int = 1000, bound=None, reach=None
) -> DataFrame:
    """(i, j, dist) with i < j; only pairs within ``max_dist`` leave their task when it is given."""
    kt = key_type(items, key)

    def emit(ka, kb, d, same):
        keep = np.ones(d.shape, dtype=bool) if max_dist is None else d <= max_dist
        if same:
            keep &= ka[:, None] < kb[None, :]
        r, c = np.nonzero(keep)
        i, j = ka[r], kb[c]
        swap = i > j
        return pd.DataFrame({"i": np.where(swap, j, i), "j": np.where(swap, i, j), "dist": d[r, c]})

    out = run_blocks(items, key, metric, emit, f"i {kt}, j {kt}, dist double", block_rows, bound, reach, within=max_dist)
    return out.withColumn("dist", F.when(~F.isnan("dist"), F.col("dist")))


def radius_join(items: DataFrame, key: str, metric, radius: float, bound=None, reach=None, block_rows: int = 1000) -> DataFrame:
    return pairwise(items, key, metric, radius, block_rows, bound, reach)


def nearest(items: DataFrame, key: str, metric, k: int, block_rows: int = 1000) -> DataFrame:
    """The k nearest other items of every item: (item, neighbour, dist, rank).

    Each task keeps k per item, so at most k rows per item and pair of blocks travel.
    """
    from weft.operators.ranking import top_k

    kt = key_type(items, key)

    def best(ki, kj, d):
        """Both sides are sorted by key, so a stable sort takes the lower key of two at one distance."""
        d = np.where(ki[:, None] == kj[None, :], np.nan, d)
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist = np.take_along_axis(d, at, axis=1)
        keep = ~np.isnan(dist)
        return pd.DataFrame({"item": np.repeat(ki, keep.sum(axis=1)), "neighbour": kj[at[keep]], "dist": dist[keep]})

    def emit(ka, kb, d, same):
        return best(ka, kb, d) if same else pd.concat([best(ka, kb, d), best(kb, ka, d.T)])

    def fast(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        ka, kb, x, y = a[key].to_numpy(), b[key].to_numpy(), stack(a["v"].to_numpy()), stack(b["v"].to_numpy())
        if not (np.isfinite(x).all() and np.isfinite(y).all()):
            return emit(ka, kb, KERNELS[metric]({"v": x}, {"v": y}), same)
        out = []
        for ki, kj, p, q in [(ka, kb, x, y)] + ([] if same else [(kb, ka, y, x)]):
            r, c, dist = euclidean_nearest(p, q, ki[:, None] == kj[None, :], k)
            out.append(closest(pd.DataFrame({"item": ki[r], "neighbour": kj[c], "dist": dist})))
        return pd.concat(out)

    def closest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "dist", "neighbour"], kind="stable")
        return rows[rows.groupby("item", sort=False, dropna=False).cumcount() < k]

    schema = f"item {kt}, neighbour {kt}, dist double"
    if metric == "euclidean":
        out = block_tasks(items.select(key, "v"), key, fast, schema, block_rows, fold=closest)
    else:
        out = run_blocks(items, key, metric, emit, schema, block_rows, fold=closest)
    return top_k(out, ["item"], [F.asc("dist"), F.asc("neighbour")], k)


def distance_stats(items: DataFrame, key: str, metric, block_rows: int = 1000, radius: float | None = None) -> DataFrame:
    """Per item the sum, number and maximum of its distances to all others, and how many lie
    within ``radius``: (item, total, n, top, near). Tasks emit one partial row per item."""
    kt = key_type(items, key)

    def part(keys, d):
        ok = ~np.isnan(d)
        safe = np.where(ok, d, 0.0)
        return pd.DataFrame({
            "item": keys, "total": safe.sum(axis=1), "n": ok.sum(axis=1),
            "top": np.where(ok, d, -np.inf).max(axis=1, initial=-np.inf),
            "near": ((safe <= radius) & ok).sum(axis=1) if radius is not None else np.zeros(len(keys), dtype=int),
        })

    def emit(ka, kb, d, same):
        if same:
            d = d.copy()
            np.fill_diagonal(d, np.nan)
            return part(ka, d)
        return pd.concat([part(ka, d), part(kb, d.T)])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("item", sort=False, dropna=False).agg({"total": "sum", "n": "sum", "top": "max", "near": "sum"}).reset_index()

    out = run_blocks(items, key, metric, emit, f"item {kt}, total double, n bigint, top double, near bigint", block_rows, fold=added)
    return out.groupBy("item").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("top").alias("top"), F.sum("near").alias("near")
    )


def max_distance(items: DataFrame, key: str, metric, block_rows: int = 1000) -> DataFrame:
    """One row (top): each task reports a single number."""
    def emit(ka, kb, d, same):
        v = d[ka[:, None] < kb[None, :]] if same else d
        v = v[~np.isnan(v)]
        return pd.DataFrame({"top": [v.max()] if v.size else []})

    return run_blocks(items, key, metric, emit, "top double", block_rows, fold=lambda rows: rows.nlargest(1, "top")).agg(F.max("top").alias("top"))


def similarity_matrix(
    items: DataFrame, key: str, metric: str = "cosine", as_distance: bool = True, scaled: bool = True,
    max_dist: float | None = None, block_rows: int = 1000,
) -> DataFrame:
    """The pair table by metric name, optionally divided by its maximum and as 1 − distance.

    ``max_dist`` applies to the unscaled distance.
    """
    pairs = pairwise(items, key, metric, max_dist, block_rows)
    if scaled:
        top = max_distance(items, key, metric, block_rows).scalar()
        pairs = pairs.withColumn("dist", F.when(top > 0, F.col("dist") / top).otherwise(F.col("dist")))
    return pairs if as_distance else pairs.withColumn("dist", 1 - F.col("dist")).withColumnRenamed("dist", "sim")


def all_pairs(items: DataFrame, key: str, payload: list[str], block_rows: int = 1000) -> DataFrame:
    """Every unordered pair of items as rows (i, j, left payload, right payload), i < j.

    An equi-join on the block pair: both sides are hashed, so blocks are even.
    """
    left, right = with_blocks(items.select(key, *payload), key, block_rows)
    a = left.select("gl", "gr", F.col(key).alias("_i"), *[F.col(p).alias(f"{p}_i") for p in payload])
    b = right.select("gl", "gr", F.col(key).alias("_j"), *[F.col(p).alias(f"{p}_j") for p in payload])
    met = a.join(b, ["gl", "gr"]).filter((F.col("gl") != F.col("gr")) | (F.col("_i") < F.col("_j")))
    flip = F.col("_i") > F.col("_j")
    out = [F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j")]
    for p in payload:
        x, y = F.col(f"{p}_i"), F.col(f"{p}_j")
        out += [F.when(flip, y).otherwise(x).alias(f"{p}_i"), F.when(flip, x).otherwise(y).alias(f"{p}_j")]
    return met.select(*out)


def pairwise_custom(items: DataFrame, key: str, vec: str, metric: Callable, max_dist: float | None = None, block_rows: int = 1000, arrays: bool = False) -> DataFrame:
    """(i, j, dist) by a caller's metric, a function of two Columns; or, with ``arrays``, of two arrays of vectors (…, dimension) that are broadcast
    against each other, for vectors of one length: then tiles of items meet in tasks, and no row is made of a pair that is too far."""
    if arrays:
        def kernel(x: dict, y: dict) -> np.ndarray:
            (x, kx), (y, ky) = filled(x["v"]), filled(y["v"])
            out = np.full((len(kx), len(ky)), np.nan)
            if kx.any() and ky.any():
                step = max(1, SPREAD // max(1, y.size))
                out[np.ix_(kx, ky)] = np.concatenate([metric(x[at : at + step, None, :], y[None, :, :]) for at in range(0, len(x), step)])
            return out

        known = items.filter(F.col(key).isNotNull()).select(key, F.col(vec).cast("array<double>").alias("v"))
        return pairwise(known, key, kernel, max_dist, block_rows).filter(F.col("i") < F.col("j"))
    out = all_pairs(items, key, [vec], block_rows).select("i", "j", metric(F.col(f"{vec}_i"), F.col(f"{vec}_j")).alias("dist"))
    return out if max_dist is None else out.filter(F.col("dist") <= max_dist)


#: Numbers of an array that a caller's metric meets at a time.
SPREAD = 1 << 17


def filled(vectors) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that are there, and which of all are."""
    there = np.array([v is not None for v in vectors], bool)
    return stack([v for v in vectors if v is not None]), there


def mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j", "dist").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "dist"))


def distance_dictionary(pairs: DataFrame) -> DataFrame:
    """Label → {label → distance}. For item sets whose row of the matrix fits one cell."""
    return mirrored(pairs).groupBy("i").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("j", "dist")))).alias("row"))


def threshold_graph_sim(sims: DataFrame, t: float | None = None) -> DataFrame:
    """Edges with similarity at least t (the mean over all pairs when t is None)."""
    limit = F.lit(t) if t is not None else sims.agg(F.avg("sim")).scalar()
    return sims.filter(F.col("sim") >= limit).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("sim").alias("weight"))


def threshold_graph_dist(pairs: DataFrame, t: float | None = None) -> DataFrame:
    """Edges with a distance of at most t that is not zero."""
    limit = F.lit(t) if t is not None else pairs.agg(F.avg("dist")).scalar()
    return pairs.filter((F.col("dist") <= limit) & (F.col("dist") != 0)).select(
        F.col("i").alias("src"), F.col("j").alias("dst"), F.col("dist").alias("weight")
    )


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def block_truth(pairs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """1 for pairs of different class, 0 else."""
    a = labels.select(F.col(key).alias("i"), F.col(label).alias("_la"))
    b = labels.select(F.col(key).alias("j"), F.col(label).alias("_lb"))
    return pairs.join(a, "i").join(b, "j").select("i", "j", (F.col("_la") != F.col("_lb")).cast("int").alias("truth"))


def abs_error_blocks(items: DataFrame, key: str, metric: str, label: str, block_rows: int = 1000) -> DataFrame:
    """Mean and sum of abs(distance − truth) over all pairs, truth being 1 for pairs of different label.

    Every block pair emits two numbers; no pair is written. Pairs without a distance are left out.
    The full symmetric matrix has twice the sum and, with its zero diagonal, n² cells.
    """
    kernel, payload = KERNELS[metric], PAYLOAD.get(metric, ["v"])

    def task(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> pd.DataFrame:
        d = kernel({c: a[c].to_numpy() for c in payload}, {c: b[c].to_numpy() for c in payload})
        err = np.abs(d - (a[label].to_numpy()[:, None] != b[label].to_numpy()[None, :]))
        keep = ~np.isnan(err)
        if same:
            keep &= a[key].to_numpy()[:, None] < b[key].to_numpy()[None, :]
        return pd.DataFrame({"n": [int(keep.sum())], "s": [float(err[keep].sum())]})

    sums = block_tasks(items.select(key, *payload, label), key, task, "n bigint, s double", block_rows)
    size = items.agg(F.count(F.lit(1))).scalar()
    total = sums.agg(F.sum("n").alias("n_pairs"), F.sum("s").alias("sum_abs"))
    return total.select(
        (F.col("sum_abs") / F.col("n_pairs")).alias("mean_abs"), "sum_abs", "n_pairs",
        (2 * F.col("sum_abs")).alias("matrix_sum"), (2 * F.col("sum_abs") / (size * size)).alias("matrix_mean"),
    )


def embedding_mean_distance(embeddings: dict[str, DataFrame], key: str, metric: str, probabilistic: bool = False) -> DataFrame:
    """Per model and item the mean scaled distance to all items, the zero to itself included."""
    from functools import reduce

    out = []
    for name, items in embeddings.items():
        s = distance_stats(items, key, metric)
        top = s.agg(F.max("top")).scalar()
        out.append(s.select(F.lit(name).alias("model"), "item", (F.col("total") / top / (F.col("n") + 1)).alias("value")))
    table = reduce(DataFrame.unionByName, out)
    return shifted_share(table, "model", "value") if probabilistic else table


def shifted_share(table: DataFrame, group: str, x: str, by_range: bool = False) -> DataFrame:
    """Per group: subtract the minimum and divide by the sum. Groups meet their totals by a join
    on the aggregated (one row per group) table, so a large group is never one window."""
    tot = table.groupBy(group).agg(F.min(x).alias("_lo"), F.sum(x).alias("_s"), F.count(F.lit(1)).alias("_n"))
    rest = F.col("_s") - F.col("_lo") * F.col("_n")
    return table.join(tot, group).withColumn(x, F.when(rest > 0, (F.col(x) - F.col("_lo")) / rest)).drop("_lo", "_s", "_n")


def embedding_radius_count(embeddings: dict[str, DataFrame], key: str, metric: str, radius: float = 0.1, probabilistic: bool = True) -> DataFrame:
    """Per model and item the neighbours within a radius of the scaled distance."""
    from functools import reduce

    out = []
    for name, items in embeddings.items():
        top = max_distance(items, key, metric).first()["top"] or 0.0  # one number
        s = distance_stats(items, key, metric, radius=radius * top)
        out.append(s.select(F.lit(name).alias("model"), "item", F.col("near").cast("double").alias("value")))
    table = reduce(DataFrame.unionByName, out)
    return shifted_share(table, "model", "value") if probabilistic else table
