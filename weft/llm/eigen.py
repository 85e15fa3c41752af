"""Symmetric eigenvectors in mixed precision: float32 first, then corrections by matrix products.

A correction (Ogita and Aishima) takes approximate eigenvectors X of A, R = I - X'X and S = X'AX, and
replaces X by X + XE, where E divides the off-diagonal entries of S by the gaps of the eigenvalues. The
error is squared each time, if the products are more precise than the result. They are here: both factors
are cut into slices of so few bits that products of slices are exact in float64, and the partial products
are added up in extended precision. Where eigenvalues lie so close together that float32 can't tell
their vectors apart, the space they span is corrected first; then the matrix is restricted to that space and
shifted by the cluster's mean, so that the gaps are large against its norm, and solved by itself.
"""

from __future__ import annotations

import numpy as np

#: The wide type of sums and of the eigenvectors while they are corrected (64 bits of mantissa or more).
WIDE = np.longdouble
#: Slices of a factor. With 20 bits and more each they hold more than the wide type does.
SLICES = 4
#: Corrections at most; float32 starts at about 1e-6, so four would do without clusters.
ROUNDS = 12
#: Eigenvalues closer than this share of the largest are solved by themselves.
CLOSE = 1e-4
#: Clusters within clusters at most.
DEPTH = 8
#: The unit of the wide type as far as the sliced products keep it.
UNIT = 2.0**-62


def sliced(a: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """Float64 matrices that add up to ``a``, each with ``bits`` bits below the largest entry of its row or column."""
    out, rest = [], a.astype(WIDE)
    for _ in range(SLICES):
        most = np.abs(rest).max(axis=axis, keepdims=True).astype(np.float64)
        step = np.ldexp(1.0, np.frexp(most)[1] - bits)
        part = (np.rint(rest / step) * step).astype(np.float64)
        out.append(part)
        rest = rest - part
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in extended precision out of exact float64 products of slices."""
    bits = (52 - int(np.ceil(np.log2(max(2, a.shape[1]))))) // 2
    left, right = sliced(a, 1, bits), sliced(b, 0, bits)
    total = np.zeros((a.shape[0], b.shape[1]), WIDE)
    for i in reversed(range(SLICES)):  # the smallest first
        for j in reversed(range(SLICES - i)):
            total += left[i] @ right[j]
    return total


def first_guess(a: np.ndarray) -> np.ndarray:
    """Eigenvectors in float32, by falling eigenvalue."""
    scale = float(np.abs(a).max()) or 1.0
    _, vectors = np.linalg.eigh((a / WIDE(scale)).astype(np.float32))
    return vectors[:, ::-1].astype(WIDE)


def clusters(values: np.ndarray, gap: float) -> list[slice]:
    """Runs of neighbouring falling values no further apart than ``gap``, of two or more."""
    starts = np.concatenate([[0], np.flatnonzero(values[:-1] - values[1:] > gap) + 1, [len(values)]])
    return [slice(int(i), int(j)) for i, j in zip(starts, starts[1:]) if j - i > 1]


def corrected(a: np.ndarray, x: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(X, eigenvalues, size of the correction). Eigenvalues no further apart than ``floor`` count as one."""
    d = len(a)
    r = np.eye(d, dtype=WIDE) - product(x.T, x)
    s = product(x.T, product(a, x))
    values = np.diag(s) / (1 - np.diag(r))
    order = np.argsort(-values, kind="stable")
    x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
    apart, turn = values[None, :] - values[:, None], s + values[None, :] * r
    # a pair is turned by a small angle only; where the gap is too narrow for that, it is made orthogonal
    far = (np.abs(apart) > floor) & (np.abs(turn) < np.abs(apart) / 8)
    e = np.where(far, turn / np.where(far, apart, 1), r / 2)
    np.fill_diagonal(e, np.diag(r) / 2)
    return x + product(x, e), values, float(np.abs(e).max())


def eigenvectors(a: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors in columns) of a symmetric matrix, both in the wide type.

    Vectors of eigenvalues that even the wide type can't tell apart are an orthonormal base of their space.
    """
    a = a.astype(WIDE)
    d = len(a)
    if d == 0 or not np.abs(a).max():
        return np.zeros(d, WIDE), np.eye(d, dtype=WIDE)
    floor = UNIT * d * float(np.abs(a).max())
    gap = CLOSE * float(np.linalg.norm(a.astype(np.float64), 2))
    x, values = refined(a, first_guess(a), gap)
    close = clusters(values, gap)
    for at in close if depth < DEPTH else []:
        x[:, at] = sub_solve(a, x[:, at], depth)
    if close:
        x, values = refined(a, x, floor)
    return values, orthonormal(x)


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns made so to the last bit: X <- X + X (I - X'X) / 2."""
    for _ in range(2):
        x = x + product(x, (np.eye(x.shape[1], dtype=WIDE) - product(x.T, x)) / 2)
    return x


def refined(a: np.ndarray, x: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(X, eigenvalues) after corrections until they are as small as the products are precise."""
    sizes: list[float] = []
    while len(sizes) < ROUNDS:
        x, values, size = corrected(a, x, floor)
        sizes.append(size)
        if size < UNIT * len(a) or (len(sizes) > 3 and size > 0.5 * sizes[-3]):
            break
    return x, values


def sub_solve(a: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """The eigenvectors of ``a`` within the space of the columns of ``x``."""
    x = orthonormal(x)
    s = product(x.T, product(a, x))
    middle = np.diag(s).mean()
    shifted = s - middle * np.eye(len(s), dtype=WIDE)
    shifted = (shifted + shifted.T) / 2
    if np.abs(shifted).max() <= UNIT * len(a) * np.abs(a).max():
        return x
    return product(x, eigenvectors(shifted, depth + 1)[1])
