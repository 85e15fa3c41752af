"""Term weights, document vectors and word-vector averages, in long form (doc, term, weight)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weft.session import cut


def term_counts(tokens: DataFrame, doc: str, term: str) -> DataFrame:
    return tokens.groupBy(doc, term).agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(counts: DataFrame, term: str) -> DataFrame:
    """``counts`` has one row per document and term, so a plain count is the document frequency."""
    return counts.groupBy(term).agg(F.count(F.lit(1)).alias("df"))


def idf_table(counts: DataFrame, doc: str, term: str, n_docs=None) -> DataFrame:
    """(term, df, idf) with idf = ln((1+n)/(1+df)) + 1."""
    n = n_docs if n_docs is not None else counts.select(doc).distinct().agg(F.count(F.lit(1))).scalar()
    return document_frequency(counts, term).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def vocabulary_limits(counts: DataFrame, doc: str, term: str, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """Terms in at least ``min_df`` documents and at most a share ``max_df`` of them."""
    n = counts.select(doc).distinct().agg(F.count(F.lit(1))).scalar()
    ok = document_frequency(counts, term).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return counts.join(ok.select(term), term, "left_semi")


def l2_normalise(weights: DataFrame, doc: str, w: str) -> DataFrame:
    """Weights over the norm of their document; the norms are an aggregate, so a long document is no window.

    The norms, a number per document, are the hashed side of the join: the weights are neither sorted nor spilled for it.
    """
    norms = weights.groupBy(doc).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias("_norm"))
    return weights.join(norms.hint("shuffle_hash"), doc).withColumn(w, F.when(F.col("_norm") > 0, F.col(w) / F.col("_norm"))).drop("_norm")


def count_vectors(tokens: DataFrame, doc: str, term: str, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """Term counts, L2-normalised: (doc, term, tf, w)."""
    counts = term_counts(tokens, doc, term)
    if min_df > 1 or max_df < 1.0:
        counts = vocabulary_limits(counts, doc, term, min_df, max_df)
    return l2_normalise(counts.withColumn("w", F.col("tf").cast("double")), doc, "w")


def tfidf_vectors(tokens: DataFrame, doc: str, term: str, min_df: int = 1, max_df: float = 1.0, n_docs=None) -> DataFrame:
    """tf × idf, L2-normalised: (doc, term, tf, df, w). ``n_docs`` saves a pass where the number of documents with a term is known."""
    counts = term_counts(tokens, doc, term)
    n = tokens.agg(F.count_distinct(doc)).scalar() if n_docs is None else n_docs
    idf = idf_table(counts, doc, term, n)
    if min_df > 1 or max_df < 1.0:
        idf = idf.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    rows = counts.join(idf.hint("shuffle_hash"), term).withColumn("w", F.col("tf") * F.col("idf"))
    return l2_normalise(rows, doc, "w").select(doc, term, "tf", "df", "w")


def tokenize_custom(df: DataFrame, key: str, text: str, tokenizer) -> DataFrame:
    """(key, term) by a caller's tokenizer, a function Column → Column of string arrays."""
    return df.select(key, F.explode(tokenizer(F.col(text))).alias("term"))


#: Bytes of vectors, and rows of tokens, that meet in one task of ``lookup_word_vectors``.
BLOCK_BYTES, BLOCK_TOKENS = 128 << 20, 4_000_000


def lookup_word_vectors(tokens: DataFrame, word: str, vectors: DataFrame, vec: str, per: str | None = None, weight: Column | None = None) -> DataFrame:
    """Token rows with the vector of a stored (word, vector) table; unknown words drop out.

    With ``per`` (a document) the rows of a document that meet the same block of vectors come as one:
    (per, vec, weight) with their weighted mean and the sum of their weights, from which ``mean_by`` makes the
    mean over all of them. No vector travels once per token then.
    """
    if per is None:
        return tokens.join(vectors.select(word, vec), word)
    return folded_lookup(tokens.select(F.col(per).alias("_d"), F.col(word).alias("_k"), weight.cast("double").alias("_w")), vectors.select(F.col(word).alias("_k"), F.col(vec).alias("_v"))).select(
        F.col("_d").alias(per), F.col("_v").alias(vec), F.col("_w").alias("weight")
    )


def folded_lookup(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """(_d, _v, _w) of tokens (_d, _k, _w) and vectors (_k, _v): blocks of documents meet blocks of vectors.

    A block of vectors has at most about BLOCK_BYTES, and a task BLOCK_TOKENS tokens. Vectors that lack entries or are of another
    length than most are joined row by row.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    vectors = vectors.filter(F.size("_v") > 0)
    sizes = vectors.agg(F.mode(F.size("_v"), True).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    dim = sizes["dim"] or 0
    plain = (F.size("_v") == dim) & ~F.exists("_v", lambda x: x.isNull())
    odd = vectors.filter(~plain)
    tokens = cut(tokens.filter(F.col("_k").isNotNull()))
    bv = max(1, -(-sizes["n"] * dim * 8 // BLOCK_BYTES))
    bt = max(1, -(-tokens.count() // (bv * BLOCK_TOKENS)), -(-2 * cores // bv) if sizes["n"] > 1000 else 1)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = tokens.select(block("_d", bt).alias("bt"), block("_k", bv).alias("bv"), "_d", "_k", "_w")
    every = F.explode(F.sequence(F.lit(0), F.lit(bt - 1)))
    right = vectors.filter(plain).select(every.alias("bt"), block("_k", bv).alias("bv"), "_k", F.col("_v").cast("array<double>"))

    def fold(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.Table.from_batches([], schema)
        names = pc.unique(b["_k"].combine_chunks())
        table = np.zeros((len(names), dim))
        copies = np.zeros(len(names))  # a word may be stored more than once
        for batch in b.select(["_k", "_v"]).to_batches():
            where = pc.index_in(batch.column("_k"), names).to_numpy(zero_copy_only=False)
            np.add.at(table, where, batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            np.add.at(copies, where, 1)
        a = a.select(["_d", "_k", "_w"]).append_column("_i", pc.index_in(a["_k"].combine_chunks(), names))
        a = a.filter(pc.is_valid(a["_i"]))
        docs = a["_d"].combine_chunks().dictionary_encode("encode")
        at = docs.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        at, word, w = at[order], a["_i"].to_numpy()[order], a["_w"].to_numpy()[order]
        sums = np.zeros((len(docs.dictionary), dim))
        total = np.bincount(at, w * copies[word], len(sums))
        for lo in range(0, len(at), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            first = np.flatnonzero(np.diff(at[part], prepend=-1))
            sums[at[part][first]] += np.add.reduceat(table[word[part]] * w[part, None], first)
        with np.errstate(divide="ignore", invalid="ignore"):
            sums /= total[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * dim), pa.array(sums.ravel()))
        return pa.Table.from_arrays([docs.dictionary, lists, pa.array(total)], schema=schema)

    schema = pa.schema([("_d", to_arrow_type(tokens.schema["_d"].dataType)), ("_v", pa.list_(pa.float64())), ("_w", pa.float64())])
    kind = tokens.schema["_d"].dataType.simpleString()
    folded = left.groupBy("bt", "bv").cogroup(right.groupBy("bt", "bv")).applyInArrow(fold, f"_d {kind}, _v array<double>, _w double")
    if odd.isEmpty():
        return folded
    return folded.unionByName(tokens.join(odd, "_k").select("_d", F.col("_v").cast("array<double>"), "_w"))


def mean_by(df: DataFrame, keys: list[str], vec: str, weight=None, out: str = "mean", dim: int | None = None) -> DataFrame:
    """(Weighted) mean vector per key.

    Every dimension is a column of one hash aggregation, so a hot key is summed map-side and a key's
    partial sums travel as one row. ``dim``, the greatest length of a vector, saves a pass over ``df``.
    """
    rows = df.select(*keys, (F.lit(1.0) if weight is None else weight).alias("_w"), F.col(vec).alias("_x")).filter(F.size("_x") > 0)
    dim = (rows.agg(F.max(F.size("_x"))).first()[0] or 0) if dim is None else dim
    cell = lambda d: F.get("_x", F.lit(d))
    sums = rows.groupBy(*keys).agg(
        F.max(F.size("_x")).alias("_n"),
        *[F.sum(F.col("_w") * cell(d)).alias(f"_s{d}") for d in range(dim)],
        *[F.sum(F.when(F.size("_x") > d, F.col("_w"))).alias(f"_c{d}") for d in range(dim)],
    )
    means = F.array(*[F.col(f"_s{d}") / F.col(f"_c{d}") for d in range(dim)]).cast("array<double>")
    return sums.select(*keys, F.slice(means, F.lit(1), F.col("_n")).alias(out))


def width(vectors: DataFrame, vec: str) -> int:
    """The greatest length of a vector."""
    return max(0, vectors.agg(F.max(F.size(vec))).first()[0] or 0)


def doc_vector_mean(word_vectors: DataFrame, doc: str, vec: str) -> DataFrame:
    return mean_by(word_vectors, [doc], vec)


def doc_vector_weighted(tokens: DataFrame, doc: str, word: str, vectors: DataFrame, vec: str, idf: DataFrame | None = None) -> DataFrame:
    """Weighted mean over token occurrences, weight = count (× idf), L2-normalised.

    The weight is given per occurrence and contains the count, so a word counts count² times.
    """
    counts = term_counts(tokens, doc, word)
    weight = (F.col("tf") * F.col("tf")).cast("double")
    if idf is not None:
        counts = counts.join(idf.select(word, "idf"), word)
        weight = weight * F.col("idf")
    rows = lookup_word_vectors(counts, word, vectors, vec, doc, weight)
    mean = mean_by(rows, [doc], vec, F.col("weight"), dim=width(vectors, vec))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    return mean.withColumn("_n", norm).select(
        doc, F.transform("mean", lambda x: F.when(F.col("_n") > 0, x / F.col("_n"))).alias("vec")
    )
