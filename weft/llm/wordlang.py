"""Numbers for language labels of words: letters, features, and a linear chain over many texts at once.

All of it works on flat numpy arrays of a batch of texts. A chain step that begins a text forgets
what was before, so a whole batch is one chain; it is cut into blocks of steps, the blocks' matrices are
multiplied level by level, and vectors run through all blocks at the same time.
"""

from __future__ import annotations

import functools
import sys

import numpy as np

from .slots import mix

#: Hashed features.
FEATURES = 1 << 16
#: Steps of a block.
STEPS = 32
#: A label's evidence in one word is at most so far (in natural logarithms) below the best label's.
FARTHEST = 20.0
#: Marks before and after a word; no letters.
BEGIN, END = 1, 2


@functools.lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, its lower case) of every code point; letters whose lower case is longer stay as they are."""
    chars = [chr(c) for c in range(sys.maxunicode + 1)]
    alpha = np.fromiter(map(str.isalpha, chars), bool, len(chars))
    lower = np.arange(len(chars), dtype=np.uint32)
    for c in np.flatnonzero(alpha).tolist():
        low = chars[c].lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return alpha, lower


class Words:
    """The words (runs of letters) of some texts: code points in lower case, starts and ends within the joined texts, owning text."""

    def __init__(self, texts: list[str]):
        alpha, lower = letters()
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = alpha[codes]
        edge = np.diff(inside)
        self.codes = lower[codes]
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(self.offsets, self.starts, side="right") - 1
        # all words one after another, without what lies between
        self.sizes = self.ends - self.starts
        self.letters = self.codes[inside[1:-1] == 1]
        self.at = np.cumsum(self.sizes) - self.sizes

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.letters), dtype=np.uint64) - np.repeat(self.at, self.sizes).astype(np.uint64)
        return mix(np.add.reduceat(mix(self.letters.astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15)), self.at))


def features(words: Words, which: np.ndarray, hashes: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of the chosen words: the word, its beginnings and ends of 1 to 4 letters, its runs of 1 to 3
    letters (with the marks at both ends), and its entry in the lexicon."""
    sizes = words.sizes[which]
    padded = sizes + 2
    at = np.cumsum(padded) - padded
    total = int(padded.sum())
    word = np.repeat(np.arange(len(which)), padded)
    place = np.arange(total) - at[word]
    codes = words.letters[np.clip(np.repeat(words.at[which], padded) + place - 1, 0, max(len(words.letters) - 1, 0))].astype(np.uint64)
    codes[at], codes[at + padded - 1] = BEGIN, END
    left = padded[word] - place
    found = [(np.arange(len(which)), hashes)]
    run = np.zeros(total, np.uint64)
    for n in range(1, 6):
        run = run * np.uint64(0x100000001B3) + np.concatenate([codes[n - 1 :], np.zeros(n - 1, np.uint64)])[:total]
        fits = left >= n
        if n == 1:
            fits &= codes > END
        elif n > 3:  # only at the ends of the word
            fits &= (place == 0) | (left == n)
        found.append((word[fits], mix(run[fits] + np.uint64(n << 40))))
    keys, entry = lexicon
    if len(keys):
        near = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        known = keys[near] == hashes
        found.append((np.flatnonzero(known), mix(entry[near[known]] + np.uint64(9 << 40))))
    return np.concatenate([w for w, _ in found]), np.concatenate([(f % np.uint64(FEATURES)).astype(np.int64) for _, f in found])


def emissions(words: Words, weights: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The evidence for every label (a column each) in every word; equal words are looked at once."""
    hashes, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    word, feature = features(words, first, hashes, lexicon)
    return np.stack([np.bincount(word, weights[feature, k], len(first)) for k in range(weights.shape[1])], axis=1)[back]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows (or matrices) of non-negative numbers divided by their largest."""
    axes = tuple(range(1, x.ndim))
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def entering(mats: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The row vector before each of a sequence of matrices, up to a factor, when ``vector`` stands before the first."""
    n, size = len(mats), mats.shape[-1]
    if n <= 2 * STEPS:
        out = np.empty((n, size))
        for i in range(n):
            out[i] = vector
            vector = vector @ mats[i]
            vector = vector / max(vector.max(), 1e-300)
        return out
    groups = -(-n // STEPS)
    full = np.concatenate([mats, np.broadcast_to(np.eye(size), (groups * STEPS - n, size, size))]).reshape(groups, STEPS, size, size)
    whole = full[:, 0]
    for j in range(1, STEPS):
        whole = scaled(whole @ full[:, j])
    state = entering(whole, vector)
    out = np.empty((groups, STEPS, size))
    for j in range(STEPS):
        out[:, j] = state
        state = scaled((state[:, None, :] @ full[:, j])[:, 0])
    return out.reshape(-1, size)[:n]


def posteriors(evidence: np.ndarray, first: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Probability of every label at every step of a chain (forward-backward), where ``first`` steps begin anew.

    ``moves`` (from, to) and ``begin`` are logarithms like ``evidence``.
    """
    n, size = evidence.shape
    if not n:
        return np.zeros((0, size))
    blocks = -(-n // STEPS)
    e = np.ones((blocks * STEPS, size))
    e[:n] = np.exp(np.maximum(evidence - evidence.max(axis=1, keepdims=True), -FARTHEST))
    e = e.reshape(blocks, STEPS, size)
    fresh = np.zeros(blocks * STEPS, bool)
    fresh[:n] = first
    fresh[0] = True
    fresh = fresh.reshape(blocks, STEPS)
    fill = np.arange(blocks * STEPS).reshape(blocks, STEPS) >= n
    step, start = np.exp(moves - moves.max()), np.exp(begin - begin.max())
    fresh_at = [np.flatnonzero(fresh[:, j]) for j in range(STEPS)]

    def advance(state: np.ndarray, j: int) -> np.ndarray:
        """Row vectors (blocks, rows, labels) after step j of their block."""
        new = state @ step
        at = fresh_at[j]
        new[at] = state[at].sum(axis=-1, keepdims=True) * start
        new *= e[:, j][:, None, :]
        if fill[-1, j]:
            new[-1] = state[-1]
        return scaled(new)

    mats = np.broadcast_to(np.eye(size), (blocks, size, size)).copy()
    for j in range(STEPS):
        mats = advance(mats, j)
    forward = np.empty((blocks, STEPS, size))
    state = entering(mats, np.ones(size))[:, None, :]
    for j in range(STEPS):
        state = advance(state, j)
        forward[:, j] = state[:, 0]
    back = entering(mats[::-1].transpose(0, 2, 1), np.ones(size))[::-1].copy()
    out = np.empty((blocks, STEPS, size))
    for j in reversed(range(STEPS)):
        out[:, j] = forward[:, j] * back
        new = (e[:, j] * back) @ step.T
        at = fresh_at[j]
        new[at] = ((e[at, j] * back[at]) @ start)[:, None]
        if fill[-1, j]:
            new[-1] = back[-1]
        back = scaled(new)
    out = out.reshape(-1, size)[:n]
    return out / out.sum(axis=1, keepdims=True)
