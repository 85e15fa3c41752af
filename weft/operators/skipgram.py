"""Skip-gram word vectors whose vocabulary stays distributed.

Sentences are dealt into stripes of bounded size. A round hands every stripe the vectors of its own words, learns
from its sentences in batches (negative sampling), and averages what the stripes learned of a word by how often they met it.
Vocabulary, vectors and averages are tables; nothing per word reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from weft.session import Rounds, cut

#: Words of a piece of a sentence, tokens of a stripe, and the least and most tokens of a batch.
PIECE, STRIPE, BATCH = 1000, 1_000_000, (32, 1024)
#: Negative words per pair, words drawn for a batch, pairs of a word whose steps add up in a batch, and the largest entry of a vector.
NEGATIVES, DRAWN, STEPS, LARGEST = 5, 64, 128, 16.0


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def add_steps(table: np.ndarray, at: np.ndarray, steps: np.ndarray, pairs: np.ndarray) -> None:
    """Add the steps of each row, which come from so many ``pairs``; those of more than STEPS pairs are scaled down, since they all start from the same values."""
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    scale = np.maximum(1.0, np.add.reduceat(pairs[order], first) / STEPS).astype(np.float32)
    table[rows] = np.clip(table[rows] + np.add.reduceat(steps[order], first) / scale[:, None], -LARGEST, LARGEST)


def learn(v: np.ndarray, c: np.ndarray, words: np.ndarray, sentence: np.ndarray, counts: np.ndarray, window: int, rates: tuple[float, float], rng) -> None:
    """One pass over the tokens ``words`` of sentences: vectors ``v`` and contexts ``c`` change in place, the rate falls linearly."""
    drawn = np.cumsum(counts**0.75)
    batch = int(np.clip(len(words) // 512, *BATCH))
    for lo in range(0, len(words), batch):
        hi = min(len(words), lo + batch)
        rate = np.float32(rates[0] + (rates[1] - rates[0]) * lo / len(words))
        start = max(0, lo - window)
        near, of = words[start : hi + window], sentence[start : hi + window]
        x, y = v[words[lo:hi]], c[near]
        reach = rng.integers(1, window + 1, hi - lo)
        dx, dy, met, of_near = np.zeros_like(x), np.zeros_like(y), np.zeros(hi - lo, np.float32), np.zeros(len(near), np.float32)
        for o in [o for d in range(1, window + 1) for o in (-d, d)]:
            a, b = max(lo, o and -o), min(hi, len(words) - o)  # centres whose neighbour at distance o exists
            if a >= b:
                continue
            me, other = slice(a - lo, b - lo), slice(a + o - start, b + o - start)
            ok = (reach[me] >= abs(o)) & (of[other] == sentence[a:b])
            g = rate * ok * (1.0 - sigmoid((x[me] * y[other]).sum(axis=1)))
            g = g.astype(np.float32)[:, None]
            dx[me] += g * y[other]
            dy[other] += g * x[me]
            met[me] += ok
            of_near[other] += ok
        no = np.searchsorted(drawn, rng.random(DRAWN) * drawn[-1], side="right").clip(max=len(drawn) - 1)
        z = c[no]
        g = -rate * sigmoid(x @ z.T) * (met * NEGATIVES / DRAWN)[:, None] * (words[lo:hi, None] != no[None, :])
        g = g.astype(np.float32)
        dx += g @ z
        add_steps(v, words[lo:hi], dx, met * (1 + NEGATIVES))
        of_no = np.full(DRAWN, met.sum() * NEGATIVES / DRAWN, np.float32)
        add_steps(c, np.concatenate([near, no]), np.concatenate([dy, g.T @ x]), np.concatenate([of_near, of_no]))


def trained(sentences: DataFrame, tokens: str, dim: int, window: int, min_count: int, seed: int, rounds: int, parts: int | None, rate: float = 0.025) -> DataFrame:
    """(word, vector array<float>) of every word that occurs ``min_count`` times, written."""
    spark = sentences.sparkSession
    clean = F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda w: w.isNotNull())
    whole = sentences.select(clean.alias("t")).filter(F.size("t") > 0)
    starts = F.sequence(F.lit(1), F.size("t"), F.lit(PIECE))
    pieces = cut(whole.select(F.explode(F.transform(starts, lambda at: F.slice("t", at, F.lit(PIECE)))).alias("t")))
    total = pieces.agg(F.sum(F.size("t"))).first()[0] or 0
    stripes = max(parts or spark.sparkContext.defaultParallelism, -(-total // STRIPE))
    pieces = cut(pieces.withColumn("p", F.floor(F.rand(seed) * stripes).cast("int")))
    local = cut(pieces.select("p", F.explode("t").alias("word")).groupBy("p", "word").agg(F.count(F.lit(1)).alias("n")))
    known = local.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    held, zero = Rounds(spark), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: F.lit(0.0).cast("float"))
    first = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: ((F.pmod(F.xxhash64("word", k, F.lit(seed)), F.lit(1 << 24)) / (1 << 24) - 0.5) / dim).cast("float"))
    now = held.cut(known.select("word", first.alias("v"), zero.alias("c")))

    def round_of(turn: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(right):
                return schema.empty_table()
            names = right["word"].combine_chunks()
            grid = lambda col: right[col].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(names), dim)
            v, c, counts = grid("v").copy(), grid("c").copy(), right["n"].to_numpy().astype(float)
            lists = left["t"].combine_chunks()
            words = pc.fill_null(pc.index_in(lists.flatten(), names), -1).to_numpy(zero_copy_only=False)
            sentence = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            keep = words >= 0
            rates = [rate * max(1e-4, 1 - t / rounds) for t in (turn, turn + 1)]
            rng = np.random.default_rng([seed, turn, left["p"][0].as_py()])
            learn(v, c, words[keep], sentence[keep], counts, window, tuple(rates), rng)
            offsets = pa.array(np.arange(len(names) + 1, dtype=np.int32) * dim)
            made = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
            return pa.Table.from_arrays([names, made(v), made(c), pa.array(counts)], schema=schema)

        return run

    schema = pa.schema([("word", pa.string()), ("v", pa.list_(pa.float32())), ("c", pa.list_(pa.float32())), ("w", pa.float64())])
    for turn in range(rounds):
        held.next()
        wanted = local.join(now, "word").groupBy("p")
        got = pieces.groupBy("p").cogroup(wanted).applyInArrow(round_of(turn), "word string, v array<float>, c array<float>, w double")
        mean = lambda col: F.array(*[(F.sum(F.col(col)[k] * F.col("w")) / F.sum("w")).cast("float") for k in range(dim)]).alias(col)
        now = held.cut(got.groupBy("word").agg(mean("v"), mean("c")))
    return cut(now.select("word", F.col("v").alias("vector")))


class SkipGram(Estimator):
    """Learns a ``SkipGramModel`` from a column of token lists."""

    def __init__(self, tokens: str, dim: int = 32, window: int = 5, min_count: int = 1, seed: int = 1, max_iter: int = 1, parts: int | None = None):
        super().__init__()
        self.settings = dict(tokens=tokens, dim=dim, window=window, min_count=min_count, seed=seed, rounds=max_iter, parts=parts)

    def _fit(self, dataset: DataFrame) -> SkipGramModel:
        return SkipGramModel(trained(dataset, **self.settings), self.settings["tokens"])


class SkipGramModel(Model, MLReadable, MLWritable):
    """A table of word vectors; a document is the mean of its words' vectors (``vec``; NULL without a known word)."""

    def __init__(self, table: DataFrame | None = None, tokens: str | None = None):
        super().__init__()
        self.table, self.tokens = table, tokens

    def getVectors(self) -> DataFrame:
        return self.table.select("word", array_to_vector(F.col("vector").cast("array<double>")).alias("vector"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from weft.operators.vectors import mean_by

        rows = cut(dataset.withColumn("_id", F.monotonically_increasing_id()))
        found = rows.select("_id", F.explode(self.tokens).alias("word")).join(self.table, "word")
        return rows.join(mean_by(found, ["_id"], "vector", out="vec"), "_id", "left").drop("_id")

    def write(self) -> MLWriter:
        return SkipGramWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return SkipGramReader()


class SkipGramWriter(MLWriter):
    def __init__(self, model: SkipGramModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"tokens": self.model.tokens})
        self.model.table.write.parquet(f"{path}/data")


class SkipGramReader(MLReader):
    def load(self, path: str) -> SkipGramModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        return SkipGramModel(self.sparkSession.read.parquet(f"{path}/data"), told["tokens"])
