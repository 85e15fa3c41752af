"""Toxic passages as maximal scoring segments.

A word, or else its longest beginning that is known, scores its log-odds between toxic and clean
training texts under an informative Dirichlet prior; every other word scores a little below zero. One linear scan finds all maximal scoring segments
(Ruzzo and Tompa). A segment counts when it is longer odds than chance: the scores of clean text follow an
extreme-value law with parameters lambda and K, so a segment S in n words has the E-value
K n exp(-lambda S). The evidence of a text is the sum over its significant segments, and a logistic
curve fitted to the training texts turns that into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, keyed, per_batch, slices, texts_of

#: Labelled rows the model learns from at most (those of the smallest hash of their id).
TRAIN_ROWS = 20_000
#: Entries of the lexicon are at least one in so many of all entries that the training texts hold, each once a text; so there are no more
#: than that, and the model is small enough to ship.
ONE_IN = 1_000_000
#: Weight of the prior: a word counts this share of its own frequency in either class, and a trace more.
PRIOR, TRACE = 0.1, 0.01
#: Words enter the lexicon with at least so many standard deviations.
LEAST_Z = 3.0
#: What every word loses, so that the mean score of clean text is negative.
DRIFT = 0.05
#: Segments with a smaller E-value are significant.
E_VALUE = 0.05

#: Beginnings that stand for words not known themselves, the longest first.
BEGINNINGS = (7, 6, 5, 4)
#: Words whose score a worker process remembers.
REMEMBERED = 500_000

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def entries_of(words: set[str]) -> set[str]:
    """The words and their beginnings (marked by a star)."""
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in BEGINNINGS))


def segments(positions: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last word, score), left to right, in linear time.

    ``positions`` are the words of the lexicon in order, ``scores`` theirs; every word loses ``drift``.
    """
    # candidates: first, last, sum before its start, sum up to its end
    stack: list[tuple[int, int, float, float]] = []
    total, at = 0.0, -1
    for p, s in zip(positions, scores):
        total -= drift * (p - at - 1)
        at = p
        before, total = total, total + s - drift
        if total <= before:
            continue
        first, left, right = p, before, total
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= right:
                break
            first, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((first, p, left, right))
    return [(first, last, right - left) for first, last, left, right in stack]


@dataclass
class Model:
    lexicon: dict[str, float]
    rate: float  # lambda
    log_k: float
    curve: tuple[float, float] = (0.0, 0.0)
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and the maximal segments of positive score."""
        words = words_of(text)
        known = self.seen
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.score(w)
        scores = [known[w] for w in words]
        positions = [i for i, s in enumerate(scores) if s]
        return len(words), segments(positions, [scores[i] for i in positions])

    def score(self, word: str) -> float:
        own = self.lexicon.get(word)
        if own is not None:
            return own
        return next((s for k in BEGINNINGS if len(word) > k and (s := self.lexicon.get(word[:k] + "*"))), 0.0)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Sum of -ln(E / E_VALUE) over the significant segments, on a log scale."""
        base = self.log_k + math.log(max(n, 1)) - math.log(E_VALUE)
        return math.log1p(sum(max(0.0, self.rate * s - base) for _, _, s in found))

    def probability(self, n: int, found: list[tuple[int, int, float]]) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, a + b * self.evidence(n, found)))))


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is a multiple of 5, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled rows, written; each distinct text once, by its largest label."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = cut(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    joined = docs.join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
    return cut(joined.groupBy("text").agg(F.max("toxic").alias("toxic")))


def word_counts(train: DataFrame) -> DataFrame:
    """(word, t, c): training texts of either class that hold the word."""
    schema = pa.schema([("word", pa.string()), ("t", pa.int64()), ("c", pa.int64())])

    def run(batches):
        for batch in slices(batches, "text"):
            counts = (Counter(), Counter())
            for text, toxic in zip(texts_of(batch.column("text")), batch.column("toxic").to_pylist()):
                counts[toxic == 1].update(entries_of(set(words_of(text))))
            words = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], schema=schema)

    partial = train.mapInArrow(run, "word string, t long, c long")
    return cut(partial.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))


def lexicon(counts: DataFrame, one_in: int) -> tuple[dict[str, float], dict[str, float], float]:
    """(log-odds by word, share of clean text by word, share of clean text outside)."""
    total = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).first()
    if not total["t"] or not total["c"]:
        return {}, {}, 1.0
    prior = PRIOR * (F.col("t") + F.col("c")) + TRACE
    mass = PRIOR * (total["t"] + total["c"]) + TRACE * total["n"]
    t, c = F.col("t") + prior, F.col("c") + prior
    odds = F.log(t / (F.lit(total["t"] + mass) - t)) - F.log(c / (F.lit(total["c"] + mass) - c))
    held = F.col("t") + F.col("c")
    often = counts.where(held * one_in >= F.lit(total["t"] + total["c"]))
    scored = often.select("word", odds.alias("s"), (odds / F.sqrt(1 / t + 1 / c)).alias("z"), (c / F.lit(total["c"] + mass)).alias("p"))
    rows = scored.where(F.abs("z") >= LEAST_Z).orderBy("word").collect()  # at most ``one_in``
    share = {r["word"]: r["p"] for r in rows}
    return {r["word"]: r["s"] for r in rows}, share, max(1.0 - sum(share.values()), 1e-9)


def decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """lambda: the positive root of sum(share * exp(lambda * score)) = 1, by bisection."""
    if not len(scores) or scores.max() <= 0:
        return 1.0
    shares = shares / shares.sum()
    value = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    low, high = 1e-3, 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps with a small ridge; the slope is not negative."""
    design = np.stack([np.ones_like(x), x], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = design.T @ (y - p) - 0.01 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1]))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, one_in: int = ONE_IN) -> Model:
    """Learn lexicon, lambda, K and the curve from at most ``rows`` labelled rows of (doc_id, toxic).

    Two numbers per training text reach the driver for K and the curve. Without both classes there is no lexicon
    and every text gets the smoothed rate of toxic rows (0 without any labels).
    """
    train = training(docs, labels, rows)
    scores, share, rest = lexicon(word_counts(train), one_in)
    values = np.array([*scores.values(), 0.0]) - DRIFT
    model = Model(scores, decay(values, np.array([*share.values(), rest])), 0.0)

    def measure(ids: list, texts: list[str]) -> dict:
        found = [model.passages(t) for t in texts]
        return {"toxic": ids, "n": [n for n, _ in found], "spans": [",".join(repr(s) for _, _, s in f) for _, f in found]}

    seen = per_batch(train.select(F.col("toxic").alias("doc_id"), "text"), measure, "toxic long, n long, spans string").collect()  # at most ``rows``
    if not seen:
        model.curve = (-50.0, 0.0)
        return model
    parsed = [(r["toxic"], r["n"], [(0, 0, float(s)) for s in r["spans"].split(",") if s]) for r in seen]
    clean = [(n, max((s for _, _, s in f), default=0.0)) for toxic, n, f in parsed if not toxic and n]
    if clean:  # the mean of a Gumbel law: (ln(K n) + Euler's constant) / lambda
        model.log_k = float(np.mean([model.rate * best - math.log(n) for n, best in clean])) - 0.5772156649
    x = np.array([model.evidence(n, f) for _, n, f in parsed])
    model.curve = logistic(x, np.array([float(t == 1) for t, _, _ in parsed]))
    return model


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, one_in: int = ONE_IN) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, score, predicted, n_passages, passages.

    ``passages`` names the significant segments as first:last word. NULL texts are empty and get the score
    of texts without evidence; NULL ids are held out; repeated rows are kept; an empty table gives no rows.
    Only id and text are read.
    """
    docs = keyed(df, id_col, text_col)
    known = labels.select(col("doc_id").cast("long").alias("doc_id"), col("toxic").alias("toxic"))
    model = fit(docs, known, rows, one_in)
    model.seen.clear()
    shipped = df.sparkSession.sparkContext.broadcast(model)  # at most ``one_in`` entries

    def run(ids: list, texts: list[str]) -> dict:
        m, out = shipped.value, {"doc_id": ids, "score": [], "n_passages": [], "passages": []}
        for text in texts:
            n, found = m.passages(text)
            base = m.log_k + math.log(max(n, 1)) - math.log(E_VALUE)
            marked = [(i, j) for i, j, s in found if m.rate * s > base]
            out["score"].append(m.probability(n, found))
            out["n_passages"].append(len(marked))
            out["passages"].append(",".join(f"{i}:{j}" for i, j in marked))
        return out

    scored = per_batch(docs, run, "doc_id long, score double, n_passages long, passages string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "passages")
