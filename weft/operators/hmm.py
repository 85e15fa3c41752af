"""Hidden Markov models over many event sequences, batch form.

A sequence is cut into chunks of at most ``chunk`` events, so one sequence may hold any share
of the data. Forward, backward and best-path steps are matrix products, which are associative:
every chunk gives its own product in parallel; the products of a key are combined level by
level, ``FAN`` into one, until one is left, and on the way down each chunk gets the vector that
enters it; the chunks then fill in their steps in parallel. No task holds more of a key than
``FAN`` products, and numpy steps through all chunks of a batch at once.

Symbols outside the model, and NULL, are no observations: such events are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weft.operators.order import positions
from weft.session import cut

#: Products that are combined into one on a level of the scan.
FAN = 64
CHUNK = 256


@dataclass(frozen=True)
class Model:
    """Initial (k), transition (k × k) and emission (k × symbols) probabilities."""

    init: tuple
    trans: tuple
    emit: tuple

    def arrays(self):
        return np.array(self.init, float), np.array(self.trans, float), np.array(self.emit, float)


def unit(x: np.ndarray) -> np.ndarray:
    s = x.sum()
    return x / s if s > 0 else x


def scaled(x: np.ndarray) -> np.ndarray:
    """Every entry of a stack divided by its sum (where that is not zero)."""
    s = x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)
    return x / np.where(s > 0, s, 1.0)


@dataclass(frozen=True)
class Algebra:
    """How vectors and matrices are multiplied: sums of products, or maxima of sums of logarithms."""

    times: Callable[[np.ndarray, np.ndarray], np.ndarray]  # (n, r, k) by (n, k, k)
    both: Callable[[np.ndarray, np.ndarray], np.ndarray]  # two weights of one step
    norm: Callable[[np.ndarray], np.ndarray]
    one: Callable[[int], np.ndarray]


SUMS = Algebra(np.matmul, np.multiply, scaled, np.eye)
BEST = Algebra(
    lambda a, b: (a[:, :, :, None] + b[:, None, :, :]).max(axis=2), np.add, lambda x: x, lambda k: np.where(np.eye(k) > 0, 0.0, -np.inf)
)


# ---------------------------------------------------------------- chunks as rows


def chunked(events: DataFrame, key: str, order: list[str], symbol: str, model: Model, chunk: int) -> DataFrame:
    """(k, chunk, syms): the symbols of each chunk in order, stored once and read by every pass."""
    known = events.filter(F.col(symbol).between(0, len(model.emit[0]) - 1))
    pos = positions(known.select(key, *order, symbol), [key], order, "_p")
    steps = pos.select(F.col(key).alias("k"), (F.col("_p") - 1).alias("step"), F.col(symbol).cast("int").alias("sym"))
    rows = steps.withColumn("chunk", F.floor(F.col("step") / chunk).cast("bigint"))
    packed = rows.groupBy("k", "chunk").agg(F.array_sort(F.collect_list(F.struct("step", "sym"))).alias("s"))
    return cut(packed.select("k", "chunk", F.transform("s", lambda x: x["sym"]).alias("syms")))


def on_rows(rows: DataFrame, fn: Callable[[pa.RecordBatch], dict], added: str) -> DataFrame:
    """The rows with the list columns that ``fn`` makes of each batch, in Arrow."""
    kinds = [c.strip().split(" ") for c in added.split(",")]
    names = [*rows.columns, *(n for n, _ in kinds)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(out[n] for n, _ in kinds)], names=names)

    return rows.mapInArrow(run, schema)


def padded(column: pa.ListArray, fill=0) -> tuple[np.ndarray, np.ndarray]:
    """Lists of different lengths as one matrix, and their lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.full((len(lengths), max(1, lengths.max(initial=0))), fill, dtype=values.dtype if len(values) else int)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out, lengths


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """One list per row, of ``lengths`` elements, from their flat values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values))


def each(matrix: np.ndarray) -> pa.ListArray:
    """One list per row of a matrix."""
    flat = np.ascontiguousarray(matrix.reshape(len(matrix), -1))
    return lists(flat.ravel(), np.full(len(flat), flat.shape[1]))


def stacked(column: pa.ListArray, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), *shape)


# ---------------------------------------------------------------- the scan


def scan(products: DataFrame, start: np.ndarray | DataFrame, algebra: Algebra, n: int) -> DataFrame:
    """(k, i, v): the vector that enters each product (k, i, m) of a key, i from 0 on without gaps.

    The vector entering i is start · m₀ · … · mᵢ₋₁. ``start`` is the same for all keys, or (k, v).
    """
    level = cut(products.select("k", "i", "m"))
    levels = [level]
    while (level.agg(F.max("i")).first()[0] or 0) > 0:
        up = level.groupBy("k", F.floor(F.col("i") / FAN).cast("bigint").alias("i")).agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])).alias("ms")
        )
        level = cut(on_rows(up, lambda b: {"m": each(prefixes(b, algebra, n)[-1])}, "m array<double>"))
        levels.append(level)
    if isinstance(start, DataFrame):
        entering = levels[-1].select("k", "i").join(start, "k")
    else:
        entering = levels[-1].select("k", "i", F.array(*[F.lit(float(x)) for x in start]).alias("v"))
    for level in reversed(levels[1:]):
        entering = cut(entering)

        def down(b: pa.RecordBatch) -> dict:
            v = stacked(b.column("v"), 1, n)
            found = [algebra.norm(algebra.times(v, p)) if j else v for j, p in enumerate([None, *prefixes(b, algebra, n)[:-1]])]
            counts = np.diff(b.column("ms").offsets.to_numpy()) // (n * n)
            every = np.stack(found, axis=1)[:, :, 0, :]
            return {"vs": lists(every[np.arange(every.shape[1]) < counts[:, None]].ravel(), counts * n)}

        given = on_rows(level.drop("m").join(entering, ["k", "i"]), down, "vs array<double>")
        at = F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("vs") / n - 1).cast("int")), lambda j: F.slice("vs", j * n + 1, F.lit(n))))
        entering = given.select("k", F.col("i").alias("_up"), at.alias("j", "v")).select("k", (F.col("_up") * FAN + F.col("j")).alias("i"), "v")
    return entering


def prefixes(batch: pa.RecordBatch, algebra: Algebra, n: int) -> list[np.ndarray]:
    """m₀, m₀ m₁, … of the products in ``ms`` of each row; a row that has ended stays as it is."""
    flat, lengths = padded(batch.column("ms"), 0.0)
    counts = lengths // (n * n)
    flat = flat[:, : flat.shape[1] // (n * n) * n * n].reshape(len(flat), -1, n, n)
    total, out = np.broadcast_to(algebra.one(n), (len(flat), n, n)), []
    for j in range(flat.shape[1]):
        total = np.where((j < counts)[:, None, None], algebra.norm(algebra.times(total, flat[:, j])), total)
        out.append(total)
    return out


# ---------------------------------------------------------------- sums of products


def chunk_products(rows: DataFrame, model: Model, algebra: Algebra, skip_first: bool) -> DataFrame:
    """The product of transition and emission per chunk: (k, chunk, m). ``skip_first`` leaves the
    transition out at the very first step of a sequence."""
    trans, emit = steps_of(model, algebra)
    n = len(trans)

    def product(b: pa.RecordBatch) -> dict:
        syms, lengths = padded(b.column("syms"))
        first = b.column("chunk").to_numpy() == 0
        total = np.broadcast_to(algebra.one(n), (len(syms), n, n))
        move = np.broadcast_to(trans, (len(syms), n, n))
        for j in range(syms.shape[1]):
            moved = algebra.times(total, move)
            if j == 0 and skip_first:
                moved = np.where(first[:, None, None], total, moved)
            step = algebra.norm(algebra.both(moved, emit[:, syms[:, j]].T[:, None, :]))
            total = np.where((j < lengths)[:, None, None], step, total)
        return {"m": each(total)}

    return on_rows(rows, product, "m array<double>").drop("syms")


def steps_of(model: Model, algebra: Algebra) -> tuple[np.ndarray, np.ndarray]:
    _, trans, emit = model.arrays()
    with np.errstate(divide="ignore"):
        return (trans, emit) if algebra is SUMS else (np.log(trans), np.log(emit))


def filled(rows: DataFrame, entering: DataFrame, fn, added: str) -> DataFrame:
    """Every chunk with the vector that enters it, and what ``fn`` makes of both."""
    return on_rows(rows.join(entering.withColumnRenamed("i", "chunk"), ["k", "chunk"]), fn, added)


def as_steps(rows: DataFrame, chunk: int, columns: dict[str, int]) -> DataFrame:
    """(k, step, columns): one row per step; a column holds ``width`` numbers per step (0: one plain number)."""
    first = next(iter(columns))
    size = F.size(first) if not columns[first] else F.size(first) / columns[first]
    at = rows.select("k", "chunk", *columns, F.explode(F.sequence(F.lit(0), size.cast("int") - 1)).alias("_j"))
    value = [(F.slice(c, F.col("_j") * w + 1, F.lit(w)) if w else F.get(c, F.col("_j"))).alias(c) for c, w in columns.items()]
    return at.select("k", (F.col("chunk") * chunk + F.col("_j")).alias("step"), *value)


def steps_first(stack: list[np.ndarray], lengths: np.ndarray) -> pa.ListArray:
    """Values per position (each chunks × width) as one list per chunk."""
    every = np.stack(stack, axis=1)
    width = every.shape[2] if every.ndim == 3 else 1
    return lists(every[np.arange(every.shape[1]) < lengths[:, None]].ravel(), lengths * width)


def forward_rows(rows: DataFrame, model: Model, chunk: int) -> DataFrame:
    init, t, e = model.arrays()
    n = len(init)
    entering = scan(chunk_products(rows, model, SUMS, True).withColumnRenamed("chunk", "i"), init, SUMS, n)

    def fill(b: pa.RecordBatch) -> dict:
        syms, lengths = padded(b.column("syms"))
        v, first, out = stacked(b.column("v"), n), b.column("chunk").to_numpy() == 0, []
        for j in range(syms.shape[1]):
            moved = v @ t
            if j == 0:
                moved = np.where(first[:, None], v, moved)
            v = scaled(moved * e[:, syms[:, j]].T)
            out.append(v)
        return {"f": steps_first(out, lengths)}

    return as_steps(filled(rows, entering, fill, "f array<double>"), chunk, {"f": n})


def backward_rows(rows: DataFrame, model: Model, chunk: int) -> DataFrame:
    """(k, step, b, nxt): normalised backward values of the step, and those of the next step.

    The same scan from the last chunk of a key to its first, over transposed products.
    """
    _, t, e = model.arrays()
    n = len(t)
    products = on_rows(
        chunk_products(rows, model, SUMS, False), lambda b: {"mt": each(stacked(b.column("m"), n, n).transpose(0, 2, 1))}, "mt array<double>"
    )
    ends = cut(rows.groupBy("k").agg(F.max("chunk").alias("_last")))
    turned = products.join(ends, "k").select("k", (F.col("_last") - F.col("chunk")).alias("i"), F.col("mt").alias("m"))
    entering = scan(turned, np.ones(n), SUMS, n).join(ends, "k").select("k", (F.col("_last") - F.col("i")).alias("i"), "v")

    def fill(b: pa.RecordBatch) -> dict:
        syms, lengths = padded(b.column("syms"))
        v = stacked(b.column("v"), n)
        out, nxt = [], []
        for j in reversed(range(syms.shape[1])):
            inside = (j < lengths)[:, None]
            nxt.append(v)
            v = np.where(inside, scaled((e[:, syms[:, j]].T * v) @ t.T), v)
            out.append(v)
        return {"b": steps_first(out[::-1], lengths), "nxt": steps_first(nxt[::-1], lengths)}

    return as_steps(filled(rows, entering, fill, "b array<double>, nxt array<double>"), chunk, {"b": n, "nxt": n})


def hmm_forward(events: DataFrame, key: str, order: list[str], symbol: str, model: Model, chunk: int = CHUNK) -> DataFrame:
    """Normalised forward probabilities: (key, step, f)."""
    return forward_rows(chunked(events, key, order, symbol, model, chunk), model, chunk).withColumnRenamed("k", key)


def hmm_backward(events: DataFrame, key: str, order: list[str], symbol: str, model: Model, chunk: int = CHUNK) -> DataFrame:
    """Normalised backward values: (key, step, b); the step's own observation is included."""
    return backward_rows(chunked(events, key, order, symbol, model, chunk), model, chunk).select(F.col("k").alias(key), "step", "b")


def hmm_posterior(events: DataFrame, key: str, order: list[str], symbol: str, model: Model, chunk: int = CHUNK) -> DataFrame:
    """State probabilities per step: forward of the step times backward of the next, normalised."""
    rows = chunked(events, key, order, symbol, model, chunk)
    both = forward_rows(rows, model, chunk).join(backward_rows(rows, model, chunk), ["k", "step"])
    g = F.zip_with("f", "nxt", lambda x, y: x * y)
    total = F.aggregate("_g", F.lit(0.0), lambda a, x: a + x)
    return both.withColumn("_g", g).withColumn("_s", total).select(
        F.col("k").alias(key), "step", F.transform("_g", lambda x: F.when(F.col("_s") > 0, x / F.col("_s"))).alias("g")
    )


# ---------------------------------------------------------------- best paths


def hmm_viterbi(events: DataFrame, key: str, order: list[str], symbol: str, model: Model, chunk: int = CHUNK) -> DataFrame:
    """(key, step, score, best, state): log score per state, best state of the step alone, and
    the state on the best path of the whole sequence. Ties go to the lower state.

    Each chunk also gives the map from its last state back to the state before it. Maps are
    matrices of zeros and ones, so the path runs back over the chunks by the same scan.
    """
    rows = chunked(events, key, order, symbol, model, chunk)
    lt, le = steps_of(model, BEST)
    n = len(lt)
    with np.errstate(divide="ignore"):
        li = np.log(model.arrays()[0])
    entering = scan(chunk_products(rows, model, BEST, True).withColumnRenamed("chunk", "i"), li, BEST, n)

    def fill(b: pa.RecordBatch) -> dict:
        syms, lengths = padded(b.column("syms"))
        v, first = stacked(b.column("v"), n), b.column("chunk").to_numpy() == 0
        scores, back, every = [], [], np.arange(len(v))
        for j in range(syms.shape[1]):
            reach = v[:, :, None] + lt
            source = reach.argmax(axis=1)
            moved = reach.max(axis=1)
            if j == 0:
                source = np.where(first[:, None], np.arange(n), source)
                moved = np.where(first[:, None], v, moved)
            inside = (j < lengths)[:, None]
            v = np.where(inside, moved + le[:, syms[:, j]].T, v)
            scores.append(v)
            back.append(np.where(inside, source, np.arange(n)))
        at, via = np.broadcast_to(np.arange(n), (len(v), n)), []
        for j in reversed(range(len(back))):
            via.append(at)
            at = back[j][every[:, None], at]
        before = np.zeros((len(v), n, n))
        before[every[:, None], np.arange(n), at] = 1.0
        flat = [s.argmax(axis=1)[:, None] for s in scores]
        return {
            "score": steps_first(scores, lengths), "best": steps_first([x.astype(np.int32) for x in flat], lengths),
            "via": steps_first([x.astype(np.int32) for x in via[::-1]], lengths), "m": each(before),
        }

    steps = cut(filled(rows, entering, fill, "score array<double>, best array<int>, via array<int>, m array<double>").drop("syms", "v"))
    ends = cut(steps.groupBy("k").agg(F.max("chunk").alias("_last"), F.max_by(F.element_at("best", -1), "chunk").alias("_end")))
    turned = steps.join(ends, "k").select("k", (F.col("_last") - F.col("chunk")).alias("i"), "m")
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: (s == F.col("_end")).cast("double"))
    found = scan(turned, ends.select("k", one_hot.alias("v")), SUMS, n).join(ends.select("k", "_last"), "k")
    lasts = found.select("k", (F.col("_last") - F.col("i")).alias("chunk"), (F.array_position("v", 1.0) - 1).cast("int").alias("last"))
    state = F.transform(F.sequence(F.lit(0), F.size("best") - 1), lambda j: F.get("via", j * n + F.col("last")))
    path = steps.join(lasts, ["k", "chunk"]).withColumn("state", state)
    return as_steps(path, chunk, {"score": n, "best": 0, "state": 0}).select(F.col("k").alias(key), "step", "score", "best", "state")
