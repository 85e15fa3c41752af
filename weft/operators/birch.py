"""Clusters by clustering features (BIRCH): a tree per partition, its leaves merged level by level, a last step on what is left.

A feature (n, sum, sum of squares) stands for a set of vectors: features add up, and centre and radius follow
from them. A tree keeps leaf entries of a radius up to a threshold; when it has more than ``leaves``
entries, the threshold rises and they go into a new tree. So a task never holds more than its tree, and what a
partition hands on is bounded whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from weft.functions.kernels import stack
from weft.session import cut

#: Leaf entries of a tree at most, entries of a node, trees merged by one task.
LEAVES, BRANCHES, FAN = 1000, 50, 16
#: What the threshold grows by when a tree is full.
GROWTH = 1.1
FEATURE = "n double, total array<double>, squares double, threshold double, part bigint"


class Node:
    """Entries as rows: the first ``size`` of n, total, squares; inner nodes have a child for each."""

    def __init__(self, dim: int, branches: int, inner: bool):
        self.n, self.total, self.squares = np.zeros(branches + 1), np.zeros((branches + 1, dim)), np.zeros(branches + 1)
        self.children: list[Node] | None = [] if inner else None
        self.size = 0

    def add(self, n: float, total: np.ndarray, squares: float, child: Node | None = None) -> None:
        k = self.size
        self.n[k], self.total[k], self.squares[k] = n, total, squares
        if child is not None:
            self.children.append(child)
        self.size += 1

    def centres(self) -> np.ndarray:
        return self.total[: self.size] / self.n[: self.size, None]

    def nearest(self, centre: np.ndarray) -> int:
        gap = self.centres() - centre
        return int(np.einsum("ij,ij->i", gap, gap).argmin())

    def sums(self) -> tuple[float, np.ndarray, float]:
        k = self.size
        return self.n[:k].sum(), self.total[:k].sum(axis=0), self.squares[:k].sum()


def radius(n, total, squares):
    """Root mean squared distance from the centre."""
    return np.sqrt(np.maximum(0.0, squares / n - (np.asarray(total) ** 2).sum(axis=-1) / n**2))


class Tree:
    """A tree of features. ``insert`` takes features, single vectors among them."""

    def __init__(self, dim: int, threshold: float, leaves: int = LEAVES, branches: int = BRANCHES):
        self.dim, self.threshold, self.leaves, self.branches = dim, threshold, leaves, branches
        self.root, self.count = Node(dim, branches, False), 0

    def insert(self, n: float, total: np.ndarray, squares: float) -> None:
        halves = self.put(self.root, n, total, squares)
        if halves:
            self.root = Node(self.dim, self.branches, True)
            for h in halves:
                self.root.add(*h.sums(), h)
        if self.count > self.leaves:
            self.rebuild()

    def put(self, node: Node, n: float, total: np.ndarray, squares: float) -> list[Node] | None:
        """Put a feature below ``node``; the two halves if that split it."""
        k = node.nearest(total / n) if node.size else -1
        if node.children is None:
            if k >= 0 and radius(node.n[k] + n, node.total[k] + total, node.squares[k] + squares) <= self.threshold:
                node.n[k] += n
                node.total[k] += total
                node.squares[k] += squares
            else:
                node.add(n, total, squares)
                self.count += 1
        else:
            halves = self.put(node.children[k], n, total, squares)
            node.n[k] += n
            node.total[k] += total
            node.squares[k] += squares
            if halves:
                node.n[k], node.total[k], node.squares[k] = halves[0].sums()
                node.children[k] = halves[0]
                node.add(*halves[1].sums(), halves[1])
        return self.split(node) if node.size > self.branches else None

    def split(self, node: Node) -> list[Node]:
        """Two nodes around the two entries farthest apart."""
        c = node.centres()
        norm = (c**2).sum(axis=1)
        gap = norm[:, None] + norm[None, :] - 2 * c @ c.T
        a, b = np.unravel_index(gap.argmax(), gap.shape)
        near = gap[:, a] <= gap[:, b]
        near[a], near[b] = True, False
        halves = [Node(self.dim, self.branches, node.children is not None) for _ in range(2)]
        for i in range(node.size):
            halves[0 if near[i] else 1].add(node.n[i], node.total[i], node.squares[i], node.children[i] if node.children is not None else None)
        return halves

    def entries(self, node: Node | None = None) -> Iterator[tuple[float, np.ndarray, float]]:
        node = node or self.root
        for i in range(node.size):
            if node.children is None:
                yield node.n[i], node.total[i], node.squares[i]
            else:
                yield from self.entries(node.children[i])

    def rebuild(self) -> None:
        """Raise the threshold, to the radius of the closest pair of a leaf at least, until the entries are few enough."""
        old = [(n, t.copy(), s) for n, t, s in self.entries()]
        least = min(self.closest(), default=0.0)
        self.threshold = max(GROWTH * self.threshold, least * (1 + 1e-9), 1e-12)
        self.root, self.count = Node(self.dim, self.branches, False), 0
        for e in old:
            self.insert(*e)

    def closest(self, node: Node | None = None) -> Iterator[float]:
        """For each leaf the radius that its two closest entries would have as one."""
        node = node or self.root
        if node.children is not None:
            for child in node.children:
                yield from self.closest(child)
        elif node.size > 1:
            c = node.centres()
            norm = (c**2).sum(axis=1)
            gap = norm[:, None] + norm[None, :] - 2 * c @ c.T
            np.fill_diagonal(gap, np.inf)
            a, b = np.unravel_index(gap.argmin(), gap.shape)
            yield float(radius(node.n[a] + node.n[b], node.total[a] + node.total[b], node.squares[a] + node.squares[b]))


def as_rows(tree: Tree, part: int) -> pd.DataFrame:
    return pd.DataFrame([[n, t, s, tree.threshold, part] for n, t, s in tree.entries()], columns=["n", "total", "squares", "threshold", "part"])


def features(df: DataFrame, vec: str, threshold: float, leaves: int = LEAVES, fan: int = FAN) -> DataFrame:
    """The leaf entries of one tree over all vectors, at most ``leaves``, written: (n, total, squares, threshold, part).

    Every partition builds its own tree; then trees of ``fan`` neighbours are merged, level by level.
    """
    rows = df.select(F.col(vec).cast("array<double>").alias("v"), F.spark_partition_id().cast("bigint").alias("part")).filter(F.size("v") > 0)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, part = None, 0
        for p in batches:
            if not len(p):
                continue
            x = stack(p["v"])
            part = int(p["part"].iloc[0])
            tree = tree or Tree(x.shape[1], threshold, leaves)
            for v, s in zip(x, np.einsum("ij,ij->i", x, x)):
                tree.insert(1.0, v, float(s))
        if tree:
            yield as_rows(tree, part)

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["part"], kind="stable")
        x = stack(p["total"])
        tree = Tree(x.shape[1], float(p["threshold"].max()), leaves)
        for n, t, s in zip(p["n"], x, p["squares"]):
            tree.insert(float(n), t, float(s))
        return as_rows(tree, int(p["part"].iloc[0]) // fan)

    level = cut(rows.mapInPandas(build, FEATURE))
    while (level.agg(F.max("part")).first()[0] or 0) > 0:
        level = cut(level.groupBy(F.floor(F.col("part") / fan)).applyInPandas(merge, FEATURE))
    return level


def ward(n: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Labels 0 to k - 1 of weighted centres, merged two by two where the squared error grows least.

    Nearest neighbours are kept per row, so a merge looks again only at rows whose neighbour it touched.
    """
    m = len(n)
    n, c, alive = n.astype(float).copy(), centres.astype(float).copy(), np.ones(m, bool)
    into = np.arange(m)

    def costs(i: int) -> np.ndarray:
        gap = c - c[i]
        cost = np.einsum("ij,ij->i", gap, gap) * n * n[i] / (n + n[i])
        cost[~alive] = np.inf
        cost[i] = np.inf
        return cost

    near, cost = np.zeros(m, int), np.full(m, np.inf)
    for i in range(m):
        found = costs(i)
        near[i], cost[i] = int(found.argmin()), found.min()
    for _ in range(max(0, m - max(1, k))):
        i = int(np.where(alive, cost, np.inf).argmin())
        a, b = sorted((i, int(near[i])))
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        alive[b] = False
        into[into == b] = a
        found = costs(a)
        near[a], cost[a] = int(found.argmin()), found.min()
        closer = alive & (found < cost)
        near[closer], cost[closer] = a, found[closer]
        for j in np.flatnonzero(alive & np.isin(near, (a, b)) & ~closer):
            if j != a:
                again = costs(int(j))
                near[j], cost[j] = int(again.argmin()), again.min()
    return np.unique(into, return_inverse=True)[1]


def birch_bins(df: DataFrame, key: str, vec: str, k: int = 16, threshold: float = 0.5, leaves: int = LEAVES) -> DataFrame:
    """(key, cluster 0 … k − 1): the cluster of the nearest leaf entry; NULL or empty vectors have NULL.

    The entries, ``leaves`` at most, are merged to k clusters on the driver and shipped. Clusters are numbered by their lowest
    entry in the order of the centres. Vectors are of one length.
    """
    found = features(df, vec, threshold, leaves).collect()
    n = np.array([r["n"] for r in found])
    if not found:
        return df.select(key, F.lit(None).cast("int").alias("cluster"))
    centres = np.array([r["total"] for r in found]) / n[:, None]
    order = np.lexsort(centres.T[::-1])
    n, centres = n[order], centres[order]
    label = ward(n, centres, k)
    norm = (centres**2).sum(axis=1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            has = p["v"].map(lambda v: v is not None and len(v) > 0).to_numpy(bool)
            out = pd.Series(pd.NA, index=range(len(p)), dtype="Int32")
            if has.any():
                x = stack(p["v"][has])
                out[np.flatnonzero(has)] = label[(norm[None, :] - 2 * x @ centres.T).argmin(axis=1)]
            yield pd.DataFrame({key: p[key], "cluster": out.to_numpy(dtype=object, na_value=None)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(vec).cast("array<double>").alias("v")).mapInPandas(assign, f"`{key}` {kind}, cluster int")
