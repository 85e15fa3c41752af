"""Distance kernels on numpy blocks. Each takes the left and the right block of a task and
gives the matrix of distances, left rows by right rows. Spark decides what meets whom."""

from __future__ import annotations

import numpy as np


def stack(series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in series]) if len(series) else np.zeros((0, 0))


def cosine(a, b):
    x, y = stack(a["v"]), stack(b["v"])
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    d = x @ y.T
    with np.errstate(divide="ignore", invalid="ignore"):
        d /= nx[:, None] * ny[None, :]
    np.subtract(1.0, d, out=d)
    d[nx == 0, :] = np.nan
    d[:, ny == 0] = np.nan
    return d


def euclidean(a, b):
    x, y = stack(a["v"]), stack(b["v"])
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        out[i] = np.sqrt(((y - row) ** 2).sum(axis=1))
    return out


def near_squares(x: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Which rows may have a squared distance of at most ``most``: by matrix product, with room for its rounding."""
    nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    both = nx[:, None] + ny[None, :]
    with np.errstate(invalid="ignore"):
        return both - 2.0 * (x @ y.T) <= most + 1e-9 * (both + most)


def euclidean_within(a, b, within):
    """``euclidean``, but infinity where it is greater than ``within``; the others are computed the same way."""
    x, y = stack(a["v"]), stack(b["v"])
    out = np.full((len(x), len(y)), np.inf)
    if within < 0:
        return out
    r, c = np.nonzero(near_squares(x, y, within * within))
    for at in range(0, len(r), 1 << 16):
        i, j = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
        out[i, j] = np.sqrt(((y[j] - x[i]) ** 2).sum(axis=1))
    return out


def euclidean_nearest(x: np.ndarray, y: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of all pairs that may be among the k nearest of a row of ``x``, those of ``same`` left out.

    Matrix products rule pairs out, with room for their rounding; the distances are those of ``euclidean``. Entries are finite.
    """
    nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    sq = nx[:, None] + ny[None, :]
    slack = 1e-9 * sq
    sq -= 2.0 * (x @ y.T)
    sq[same] = np.inf
    if k < len(y):
        top = np.partition(sq + slack, k - 1, axis=1)[:, k - 1]  # k pairs are at most this far
        r, c = np.nonzero(sq - slack <= top[:, None])
    else:
        r, c = np.nonzero(~same)
    keep = ~same[r, c]
    r, c = r[keep], c[keep]
    return r, c, np.concatenate([np.zeros(0), *[np.sqrt(((y[c[at : at + (1 << 16)]] - x[r[at : at + (1 << 16)]]) ** 2).sum(axis=1)) for at in range(0, len(r), 1 << 16)]])


def emd(a, b):
    """Components read as samples; equal length, so sorted values are matched."""
    x, y = np.sort(stack(a["v"]), axis=1), np.sort(stack(b["v"]), axis=1)
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        out[i] = np.abs(y - row).mean(axis=1)
    return out


def energy_row(row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """sqrt(2 ∫ (F − G)²) of one sample and the rows of ``y``."""
    n, m = len(row), y.shape[1]
    step = np.concatenate([np.full(n, 1.0 / n), np.full(m, -1.0 / m)])
    merged = np.concatenate([np.broadcast_to(row, (len(y), n)), y], axis=1)
    order = np.argsort(merged, axis=1, kind="stable")
    vals = np.take_along_axis(merged, order, axis=1)
    gap = np.cumsum(step[order], axis=1)[:, :-1]
    return np.sqrt(2.0 * (gap**2 * np.diff(vals, axis=1)).sum(axis=1))


def energy(a, b):
    """sqrt(2 ∫ (F − G)²) with the components as samples."""
    x, y = stack(a["v"]), stack(b["v"])
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        out[i] = energy_row(row, y)
    return out


def bin_integrals(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """∫ F over each bin, over the root of the bin's width: by Cauchy and Schwarz the squared distance of two such rows is at most ∫ (F − G)²."""
    out = np.empty((len(x), len(edges) - 1))
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        out[:, k] = np.clip(hi - x, 0.0, hi - lo).mean(axis=1) / np.sqrt(hi - lo)
    return out


def energy_within(a, b, within, bins: int = 48):
    """``energy``, but infinity where a bound by the integrals over bins is greater than ``within``."""
    x, y = stack(a["v"]), stack(b["v"])
    out = np.full((len(x), len(y)), np.inf)
    values = np.concatenate([x.ravel(), y.ravel()])
    values = values[np.isfinite(values)]
    if within < 0 or not len(values):
        return out
    edges = np.unique(np.quantile(values, np.linspace(0.0, 1.0, bins + 1)))
    near = near_squares(bin_integrals(x, edges), bin_integrals(y, edges), within * within / 2.0) if len(edges) > 1 else np.ones(out.shape, bool)
    for i, row in enumerate(x):
        at = np.flatnonzero(near[i])
        if len(at):
            out[i, at] = energy_row(row, y[at])
    return out


def jaccard_bits(a, b):
    """Share of unequal positions among those not both zero; two zero vectors have distance 0."""
    x, y = stack(a["v"]), stack(b["v"])
    if all(((z == 0) | (z == 1)).all() for z in (x, y)):  # counts are products of bits
        common = x @ y.T
        both = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :]
        some = both - common
        return np.where(some > 0, (both - 2.0 * common) / np.maximum(some, 1.0), 0.0)
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        some = (y != 0) | (row != 0)
        n = some.sum(axis=1)
        out[i] = np.where(n > 0, ((y != row) & some).sum(axis=1) / np.maximum(n, 1), 0.0)
    return out


def path_grid(side) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(courses, positions, presence, semesters) of a block's paths over the courses they use; ``"grid"`` holds it where it was made before."""
    if "grid" in side:
        return side["grid"]
    catalog = sorted({c for cs in side["courses"] for c in cs})
    index = {c: i for i, c in enumerate(catalog)}
    sems = np.asarray(side["n_sem"], dtype=np.int32)
    pos = np.repeat(sems[:, None], len(catalog), axis=1)
    has = np.zeros((len(sems), len(catalog)), dtype=bool)
    for r, (cs, ps) in enumerate(zip(side["courses"], side["pos"])):
        cols = [index[c] for c in cs]
        pos[r, cols] = ps
        has[r, cols] = True
    return catalog, pos, has, sems


def path_layout(a, b):
    """Positions and presence of both blocks' paths over the courses the two blocks use."""
    grids = path_grid(a), path_grid(b)
    catalog = sorted({c for g in grids for c in g[0]})
    index = {c: i for i, c in enumerate(catalog)}

    def lay(names, pos, has, sems):
        if len(names) == len(catalog):
            return pos, has
        cols = [index[c] for c in names]
        wide = np.repeat(sems[:, None], len(catalog), axis=1)
        there = np.zeros((len(sems), len(catalog)), dtype=bool)
        wide[:, cols], there[:, cols] = pos, has
        return wide, there

    return lay(*grids[0]), lay(*grids[1])


def pair_chunks(n: int, width: int):
    """The pairs r < c of n columns, about ``width`` at a time."""
    start = 0
    while start < n - 1:
        stop, size = start, 0
        while stop < n - 1 and (not size or size + n - 1 - stop <= width):
            size += n - 1 - stop
            stop += 1
        rows = np.arange(start, stop)
        counts = n - 1 - rows
        r = np.repeat(rows, counts)
        yield r, np.arange(size) - np.repeat(np.cumsum(counts) - counts, counts) + r + 1
        start = stop


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x · yᵀ of small whole numbers; exact, as the sums of a chunk stay below 2^24."""
    return x.astype(np.float32) @ y.astype(np.float32).T


def signs_equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many columns two rows of signs agree: of -1, 0 and 1 two agree in 1 - x² - y² + (3x²y² + xy) / 2."""
    xx, yy = x * x, y * y
    both = products(np.concatenate([x, xx], axis=1), np.concatenate([y, 3 * yy], axis=1))
    return x.shape[1] - xx.sum(axis=1, dtype=np.int64)[:, None] - yy.sum(axis=1, dtype=np.int64)[None, :] + both * 0.5


def union_sizes(ha: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """Courses that at least one of two paths has."""
    return ha.sum(axis=1)[:, None] + hb.sum(axis=1)[None, :] - products(ha, hb).astype(float)


def course_orders(side, pos: np.ndarray, has: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the course pairs r, c of a block's paths, and which pairs a path has both courses of; kept with a block that uses all the courses, if they are one chunk."""
    own = "grid" in side and pos is side["grid"][1] and 2 * len(r) == pos.shape[1] * (pos.shape[1] - 1)
    if own and "orders" in side:
        return side["orders"]
    found = np.sign(pos[:, r] - pos[:, c]).astype(np.int8), has[:, r] & has[:, c]
    if own:
        side["orders"] = found
    return found


def path_order(a, b, cells: int = 8_000_000):
    """Course pairs of the union whose order differs; a missing course stands at the path's number of semesters.

    Orders that agree are counted over the pairs of all courses, two products for each pair of paths. Courses missing in
    both paths agree with each other, and with a course of the union if it lies on the same side of both paths' ends.
    """
    (pa, ha), (pb, hb) = path_layout(a, b)
    n = pa.shape[1]
    agree = np.zeros((len(pa), len(pb)))
    for r, c in pair_chunks(n, max(1, cells // max(1, len(pa) + len(pb)))):
        agree += signs_equal(course_orders(a, pa, ha, r, c)[0], course_orders(b, pb, hb, r, c)[0])
    union = union_sizes(ha, hb)
    out = n - union
    ends = [np.sign(p - np.asarray(s["n_sem"], dtype=np.int32)[:, None]).astype(np.int8) * h for p, h, s in ((pa, ha, a), (pb, hb, b))]
    agree -= out * (out - 1) / 2 + (signs_equal(*ends) - out) * out
    return union * (union - 1) / 2 - agree


def path_order_share_both(a, b, cells: int = 8_000_000):
    """Shares of the union's course pairs whose order differs, with ``a`` read as the left paths and with ``b`` read as them.

    The left path reads a pair it lacks a course of as "same", the right one as "after". So no pair outside the union agrees,
    and what agrees is a sum of products: of the orders (0 where a course is missing), of their squares, and of one
    path's orders with the pairs that the other lacks a course of.
    """
    (pa, ha), (pb, hb) = path_layout(a, b)
    n = pa.shape[1]
    one, two = np.zeros((len(pa), len(pb))), np.zeros((len(pa), len(pb)))
    for r, c in pair_chunks(n, max(1, cells // max(1, len(pa) + len(pb)))):
        (x, no_x), (y, no_y) = ((order * full, ~full) for order, full in (course_orders(a, pa, ha, r, c), course_orders(b, pb, hb, r, c)))
        xx, yy = x * x, y * y
        met = products(np.concatenate([x, xx], axis=1), np.concatenate([y, 3 * yy], axis=1)) * 0.5
        nx, ny = xx.sum(axis=1, dtype=np.int64)[:, None], yy.sum(axis=1, dtype=np.int64)[None, :]
        # the pairs a right path lacks a course of have the sign 1: it agrees with 1, and with no 0 or -1
        after = len(r) - nx - ny + met
        one += after - no_y.sum(axis=1)[None, :] + products(3 * xx + x, no_y) * 0.5
        two += after - no_x.sum(axis=1)[:, None] + products(no_x, 3 * yy + y) * 0.5
    union = union_sizes(ha, hb)
    pairs = union * (union - 1) / 2
    return tuple(np.where(pairs > 0, (pairs - agree) / np.maximum(pairs, 1), np.nan) for agree in (one, two))


def path_order_share(a, b):
    return path_order_share_both(a, b)[0]


def path_ends(a, b):
    """Of both blocks, per semester: courses at or before it less, from a path's end on, all it has; whether the path has ended. And the sizes of the unions.

    Where paths have ended, the courses they lack count too, so the cumulative count is the first number, plus the size of the union where the second holds.
    """
    (pa, ha), (pb, hb) = path_layout(a, b)
    sems = [np.asarray(s["n_sem"], dtype=np.int64) for s in (a, b)]
    top = int(max(x.max(initial=0) for x in (pa, pb, *sems))) + 1

    def side(pos, has, sem):
        counts = np.cumsum(np.stack([((pos == t) & has).sum(axis=1) for t in range(top)], axis=1), axis=1).astype(float)
        ended = (np.arange(top) >= sem[:, None]).astype(float)
        return counts - has.sum(axis=1)[:, None] * ended, ended

    return side(pa, ha, sems[0]), side(pb, hb, sems[1]), union_sizes(ha, hb)


def path_emd(a, b):
    """Differences of the two cumulative position distributions, added up over the semesters."""
    (ca, ea), (cb, eb), union = path_ends(a, b)
    total = np.zeros_like(union)
    for t in range(ca.shape[1]):
        gap = ca[:, t, None] - cb[None, :, t] + union * (ea[:, t, None] - eb[None, :, t])
        total += np.abs(np.where(union > 0, gap / np.maximum(union, 1), 0.0))
    return total


def path_energy(a, b):
    """sqrt(2 Σ gap²) of the cumulative position distributions; the square of a gap (counts plus union times ended) is multiplied out, so matrix products add it up."""
    (ca, ea), (cb, eb), union = path_ends(a, b)
    own = lambda x, y: (x * y).sum(axis=1)
    counts = own(ca, ca)[:, None] + own(cb, cb)[None, :] - 2.0 * (ca @ cb.T)
    mixed = own(ca, ea)[:, None] + own(cb, eb)[None, :] - ca @ eb.T - ea @ cb.T
    ended = own(ea, ea)[:, None] + own(eb, eb)[None, :] - 2.0 * (ea @ eb.T)
    squares = counts + union * (2.0 * mixed + union * ended)  # whole numbers
    return np.where(union > 0, np.sqrt(2.0 * squares) / np.maximum(union, 1), 0.0)


def jaccard_set(a, b):
    """1 − common / union of word sets; two empty sets have distance 0."""
    index: dict = {}
    for side in (a, b):
        for words in side["words"]:
            for w in words:
                index.setdefault(w, len(index))

    def bits(side):
        m = np.zeros((len(side["words"]), len(index)), dtype=np.float32)
        for r, words in enumerate(side["words"]):
            m[r, [index[w] for w in words]] = 1.0
        return m

    x, y = bits(a), bits(b)
    common = (x @ y.T).astype(float)
    union = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - common
    return np.where(union > 0, 1.0 - common / np.maximum(union, 1), 0.0)


KERNELS = {
    "cosine": cosine,
    "euclidean": euclidean,
    "emd": emd,
    "energy": energy,
    "jaccard_bits": jaccard_bits,
    "jaccard_set": jaccard_set,
    "order": path_order,
    "order_share": path_order_share,
    "path_emd": path_emd,
    "path_energy": path_energy,
}

#: Kernels that leave out (as infinity) what lies beyond a distance.
WITHIN = {"euclidean": euclidean_within, "energy": energy_within}

#: Kernels that give two matrices, left items by right items: read from the left item, and read from the right item.
BOTH = {"order_share": path_order_share_both}

#: What a kernel makes of a block by itself (``grid``), once for all blocks it meets.
GRIDS = {"order": path_grid, "order_share": path_grid, "path_emd": path_grid, "path_energy": path_grid}
