"""Quality rules for documents, with verdicts on hosts that the documents inherit.

Base rules read one text. Host rules aggregate their failures by host, shrink each rate towards
the corpus by a beta prior fitted to the hosts (moments), and join the verdict back. A host is
rejected when even the low end of its shrunk rate has clearly worse odds than the prior's mean; of its documents only those
without any minor fault stay, so that clean documents survive a bad neighbourhood.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, col, cut, extended, texts_of

#: The characters counted as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT = 50  # per cent of the words

#: A host is rejected when the odds of its shrunk rate, less so many standard deviations, exceed so many times those of the prior's mean.
ODDS = 2.0
DEVIATIONS = 2.0
#: Minor faults, in per cent: of repeated words, of symbols to characters of words, of repeated lines.
MINOR = {"n_repeat_words": 20, "n_symbols": 5, "n_dup_lines": 1}

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(text: str) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows of three)."""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), word_chars, symbols, repeated_lines(text), repeated_words(words)


def repeated_lines(text: str) -> int:
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACES):
            seen.add(line)
    return again


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    base = len(number)
    pairs = ids[:-1] * base + ids[1:]
    if base > 2_000_000:  # keep pair * base + id within 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * base + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


def with_measures(df: DataFrame, text_col: str = "text", prefix: str = "weft_") -> DataFrame:
    """``df`` and the five counts of its text, named with ``prefix``; one pass, nothing shuffled."""
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> dict:
        counts = np.array([measure(t) for t in texts_of(batch.column(at))], np.int64).reshape(-1, len(FIELDS))
        return {prefix + f: counts[:, i] for i, f in enumerate(FIELDS)}

    return extended(df, text_col, run, {prefix + f: "long" for f in FIELDS})


def failed(prefix: str = "") -> Column:
    words, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT * words)


def minor_fault(prefix: str = "") -> Column:
    p = lambda name: F.col(prefix + name)
    return (
        (100 * p("n_repeat_words") > MINOR["n_repeat_words"] * p("n_words"))
        | (100 * p("n_symbols") > MINOR["n_symbols"] * p("word_chars"))
        | (100 * p("n_dup_lines") > MINOR["n_dup_lines"] * p("n_words"))
    )


def host_failures(measured: DataFrame, host: str) -> DataFrame:
    """(host, n, n_failed), written: the size of what is joined later is then known."""
    return cut(measured.groupBy(col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(failed().cast("long")).alias("n_failed")))


def host_verdicts(hosts: DataFrame) -> DataFrame:
    """(host, n, n_failed, rate, rejected): rates shrunk by a beta prior fitted to all hosts.

    Mean m and variance v of the hosts' rates (each host weighs as its documents) give the prior's
    strength k = m (1 - m) / v - 1, at least 1; the rate is (failed + k m) / (n + k). Without
    any spread between hosts all of them get m. A NULL host is a host of its own.
    """
    share = F.col("n_failed") / F.col("n")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("n_failed").alias("f"), F.sum(F.col("n") * share * share).alias("q")).first()
    mean = total["f"] / total["n"] if total["n"] else 0.0
    spread = max(total["q"] / total["n"] - mean * mean, 0.0) if total["n"] else 0.0
    strength = max(1.0, mean * (1 - mean) / spread - 1) if spread > 1e-12 else 1e12
    a, b = F.col("n_failed") + F.lit(strength * mean), F.col("n") - F.col("n_failed") + F.lit(strength * (1 - mean))
    rate = a / (a + b)
    low = rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (a + b + 1))
    worse = low * (1 - mean) > ODDS * mean * (1 - low)
    return hosts.select("host", "n", "n_failed", rate.alias("rate"), worse.alias("rejected"))


def judged(measured: DataFrame, verdicts: DataFrame, host: str, prefix: str = "") -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept`` (names with ``prefix``). Only rejected hosts are joined."""
    bad = cut(verdicts.where("rejected").select(F.col("host").alias("weft_host"), F.lit(True).alias("weft_rejected")))
    joined = measured.join(bad, col(host).eqNullSafe(F.col("weft_host")), "left")
    fine = ~(F.coalesce("weft_rejected", F.lit(False)) & minor_fault(prefix))
    return joined.withColumns({f"{prefix}base_failed": failed(prefix), f"{prefix}kept": ~failed(prefix) & fine}).drop("weft_host", "weft_rejected")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source") -> DataFrame:
    """One row per row of ``df``: doc_id, the five counts, base_failed, kept, and the host.

    NULL or empty texts have no words and fail; NULL ids and hosts are kept as they are; repeated
    rows are judged alike; an empty table gives no rows. Other columns are not read.
    """
    docs = df.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"), col(host).alias("host"))
    measured = cut(with_measures(docs, prefix="").drop("text"))
    return judged(measured, host_verdicts(host_failures(measured, "host")), "host")


def keep_good(df: DataFrame, text_col: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``df`` that pass, with all their columns.

    The texts are measured twice (once for the hosts, once for the rows) instead of being written
    or shuffled; rejected hosts reach the rows by a broadcast only if their size allows it. NULL and empty texts have
    no words and go; rows without a host are one host; repeated rows are judged alike and all stay or go; an empty table gives no rows.
    """
    narrow = df.select(col(text_col).cast("string").alias("text"), col(host).alias("host"))
    verdicts = host_verdicts(host_failures(with_measures(narrow, prefix="").drop("text"), "host"))
    out = judged(with_measures(df, text_col), verdicts, host, "weft_").where("weft_kept")
    return out.select([col(c) for c in df.columns])
