"""Language of texts by labels of their words, which may change within a text.

A linear-chain conditional random field labels every word: affixes, runs of letters and an entry in a lexicon speak for
languages, learned transitions say how readily a text goes on in another one. Training sequences are put together from
stretches of labelled documents of several languages, since documents carry one label only. Forward and backward
sums give each word's probabilities; a text's language is the one with most of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, keyed, per_batch, slices, texts_of
from .slots import mix
from .toxicity import held_out
from .wordlang import FEATURES, Words, emissions, features, posteriors

#: Labelled rows learned from: at most so many of a language, and in all (those of the smallest hash).
ROWS_PER_LANGUAGE, TRAIN_ROWS = 500, 8_000
#: A language's rows are first chosen from in so many cells, so that a common one isn't sorted by one task.
CELLS = 64
#: Of each row, this many stretches, evenly spread over the whole text, of so many words at most.
STRETCHES, STRETCH = 4, 24
#: Stretches of a training sequence.
SPLICED = 6
#: Of every so many rows one feeds the lexicon; the others fit the weights, so that its entries are weighed by words it has not seen.
LEXICON_SHARE = 2
#: Steps of the fit, their rate, and the pull of the weights to zero.
ROUNDS, RATE, RIDGE = 80, 0.1, 0.02
#: What a text without a letter is.
UNDETERMINED = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (FEATURES, labels)
    lexicon: tuple[np.ndarray, np.ndarray]  # sorted hashes of words, entries
    moves: np.ndarray
    begin: np.ndarray

    def words(self, texts: list[str]) -> tuple[Words, np.ndarray]:
        """The words of the texts and the probability of each label at each word."""
        words = Words(texts)
        first = np.diff(words.text, prepend=-1) != 0
        return words, posteriors(emissions(words, self.weights, self.lexicon), first, self.moves, self.begin)


def training_rows(docs: DataFrame, per_language: int, rows: int) -> DataFrame:
    """(lang, key, text) of at most ``rows`` labelled rows that are not held out, written."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("key", F.xxhash64("doc_id", "text"))
    # hash values spread evenly: a cell holds more than four times its share of a language's smallest ones next to never
    cell = Window.partitionBy("lang", F.pmod("key", F.lit(CELLS))).orderBy("key")
    some = usable.select("lang", "key").withColumn("n", F.row_number().over(cell)).where(F.col("n") <= 8 + 4 * per_language // CELLS)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = some.withColumn("n", rank).where(F.col("n") <= per_language).orderBy("n", "lang").limit(rows)
    return cut(usable.join(F.broadcast(cut(chosen.select("lang", "key").distinct())), ["lang", "key"]).dropDuplicates(["lang", "key"]).select("lang", "key", "text"))


def stretches(rows: DataFrame) -> DataFrame:
    """(lang, key, part, text): words of the stretches of each row, a space between them."""
    schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("part", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in slices(batches, "text"):
            out = []
            for lang, key, text in zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), texts_of(batch.column("text"))):
                words = Words([text])
                size = min(STRETCH, len(words))
                if not size:
                    continue
                for part, start in enumerate(sorted({round(k * (len(words) - size) / (STRETCHES - 1)) for k in range(STRETCHES)})):
                    out.append({"lang": lang, "key": key, "part": part, "text": " ".join(text[a : min(b, a + 64)] for a, b in zip(words.starts[start : start + size].tolist(), words.ends[start : start + size].tolist()))})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, "lang string, key long, part long, text string")


def lexicon_of(parts: list[tuple[int, str]], labels: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, entries) of the words seen twice or more; an entry is the word's commonest label and how much of its use that is."""
    words = Words([t for _, t in parts])
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    own = np.array([label for label, _ in parts])[words.text]
    hashes, back = np.unique(words.hashes(), return_inverse=True)
    counts = np.bincount(back * labels + own, minlength=len(hashes) * labels).reshape(-1, labels)
    total = counts.sum(axis=1)
    keep = total > 1
    share = (4 * counts.max(axis=1) // np.maximum(total, 1)).astype(np.uint64)
    return hashes[keep], (counts.argmax(axis=1).astype(np.uint64) * np.uint64(8) + share)[keep]


def spliced(parts: list[tuple[int, str]]) -> tuple[list[str], np.ndarray]:
    """Training texts out of SPLICED stretches in shuffled order, and the label of every word.

    The i-th of them has its last i % 4 quarters cut off, so that languages change after few words and after many.
    """
    order = np.argsort(mix(np.arange(len(parts), dtype=np.uint64) + np.uint64(1)))
    texts, labels = [], []
    for at in range(0, len(order), SPLICED):
        words = []
        for i in order[at : at + SPLICED].tolist():
            label, text = parts[i]
            own = text.split(" ")
            own = own[: max(1, len(own) * (4 - i % 4) // 4)]
            words += own
            labels += [label] * len(own)
        texts.append(" ".join(words))
    return texts, np.array(labels)


def fit(rows: list[tuple[str, int, int, str]]) -> Model:
    """The field fitted to (lang, key, part, text) stretches by Adam steps on the penalised log-likelihood of all sequences."""
    rows = sorted(rows)
    names = sorted({r[0] for r in rows})
    size = len(names)
    if size < 2:
        return Model(names, np.zeros((FEATURES, size)), lexicon_of([], size), np.zeros((size, size)), np.zeros(size))
    parts = [(names.index(lang), key % LEXICON_SHARE == 0, text) for lang, key, _, text in rows]
    lexicon = lexicon_of([(k, t) for k, lexical, t in parts if lexical], size)
    texts, y = spliced([(k, t) for k, lexical, t in parts if not lexical] or [(k, t) for k, _, t in parts])
    words = Words(texts)
    hashes, one, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    word, feature = features(words, one, hashes, lexicon)
    # sequences in rows, shorter ones filled up
    n, lengths = len(texts), np.bincount(words.text, minlength=len(texts))
    at = np.arange(len(words)) - (np.cumsum(lengths) - lengths)[words.text]
    mask = np.zeros((n, lengths.max()), bool)
    mask[words.text, at] = True
    labels = np.zeros(mask.shape, int)
    labels[words.text, at] = y
    theta = [np.zeros((FEATURES, size)), np.zeros((size, size)), np.zeros(size)]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, ROUNDS + 1):
        weights, moves, begin = theta
        score = np.stack([np.bincount(word, weights[feature, k], len(one)) for k in range(size)], axis=1)[back]
        emit = np.zeros((*mask.shape, size))
        emit[words.text, at] = score
        gap, moved, started = likelihood_gradient(emit, labels, mask, moves, begin)
        gap = gap[words.text, at]
        by_word = np.stack([np.bincount(back, gap[:, k], len(one)) for k in range(size)], axis=1)
        slope = [np.stack([np.bincount(feature, by_word[word, k], FEATURES) for k in range(size)], axis=1), moved, started]
        for i in range(3):
            g = slope[i] - RIDGE * theta[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g**2
            theta[i] = theta[i] + RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Model(names, theta[0], lexicon, theta[1], theta[2])


def likelihood_gradient(emit: np.ndarray, labels: np.ndarray, mask: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed minus expected counts: of labels at each place (sequence, place, label), of moves, and of first labels."""
    n, longest, size = emit.shape
    e = np.exp(np.maximum(emit - emit.max(axis=2, keepdims=True), -50.0))
    step, start = np.exp(moves), np.exp(begin)
    forward, back, norm = np.empty_like(e), np.ones_like(e), np.ones((n, longest))
    for t in range(longest):
        new = (forward[:, t - 1] @ step if t else start) * e[:, t]
        norm[:, t] = np.where(mask[:, t], new.sum(axis=1), 1)
        forward[:, t] = np.where(mask[:, t, None], new / norm[:, t, None], forward[:, t - 1] if t else 1)
    moved = np.zeros_like(moves)
    for t in range(longest - 1, 0, -1):
        on = mask[:, t]
        ahead = e[:, t] * back[:, t] / norm[:, t, None]
        back[:, t - 1] = np.where(on[:, None], ahead @ step.T, 1)
        moved -= step * (forward[on, t - 1].T @ ahead[on])
        np.add.at(moved, (labels[on, t - 1], labels[on, t]), 1)
    marginal = forward * back
    seen = np.zeros_like(e)
    np.put_along_axis(seen, labels[..., None], 1, axis=2)
    gap = (seen - marginal) * mask[..., None]
    return gap, moved, gap[:, 0].sum(axis=0)


def spans_of(words: Words, labels: np.ndarray, names: list[str], texts: int) -> list[str]:
    """Per text its stretches of one label as start:end:label (code points, end exclusive), comma-joined."""
    out: list[list[str]] = [[] for _ in range(texts)]
    if len(words):
        new = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
        last = np.concatenate([new[1:], [len(words)]]) - 1
        own = words.text[new]
        shift = words.offsets[own]
        for text, start, end, label in zip(own.tolist(), (words.starts[new] - shift).tolist(), (words.ends[last] - shift).tolist(), labels[new].tolist()):
            out[text].append(f"{start}:{end}:{names[label]}")
    return [",".join(s) for s in out]


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = ROWS_PER_LANGUAGE, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, lang_pred, score, n_words, spans.

    ``score`` is the mean probability of the predicted label over the words; of equal ones the first by name is
    predicted. ``spans`` are the stretches of one label. A NULL text or one without a letter is ``und`` with score 0, and so is
    every text where no row can be learned from; with one language learned, all others are that. Rows with a NULL id are held out, repeated rows are
    kept, an empty table gives no rows. Only id, text and the language of rows learned from are read; at most ``rows`` rows reach the driver, by
    stretches of words.
    """
    docs = keyed(df, id_col, text_col)
    labelled = df.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), col(lang_col).cast("string").alias("lang"))
    found = stretches(training_rows(labelled, per_language, rows)).collect()
    model = fit([tuple(r) for r in found])
    shipped = df.sparkSession.sparkContext.broadcast(model)  # FEATURES rows, and a lexicon bounded by the rows

    def run(ids: list, texts: list[str]) -> dict:
        m = shipped.value
        out = {"doc_id": ids, "lang_pred": [UNDETERMINED] * len(ids), "score": [0.0] * len(ids), "n_words": [0] * len(ids), "spans": [""] * len(ids)}
        if not m.labels:
            return out
        words, p = m.words(texts)
        count = np.bincount(words.text, minlength=len(texts))
        mass = np.stack([np.bincount(words.text, p[:, k], len(texts)) for k in range(len(m.labels))], axis=1)
        best = mass.argmax(axis=1)
        share = mass[np.arange(len(texts)), best] / np.maximum(count, 1)
        for i in np.flatnonzero(count).tolist():
            out["lang_pred"][i], out["score"][i] = m.labels[best[i]], min(1.0, float(share[i]))
        out["n_words"] = count.tolist()
        out["spans"] = spans_of(words, p.argmax(axis=1), m.labels, len(texts))
        return out

    labels = per_batch(docs, run, "doc_id long, lang_pred string, score double, n_words long, spans string")
    return labels.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "spans")
