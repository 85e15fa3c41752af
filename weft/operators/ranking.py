"""Ranks, top-k, samples, splits and the two greedy selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weft.operators.order import positions
from weft.operators.relational import minmax_scale
from weft.session import cut


def top_k(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group. Spark keeps k rows per group and partition before the
    shuffle (``WindowGroupLimit``), so a hot group never travels whole."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def topk_terms_per_dimension(vectors: DataFrame, doc: str, vec: str, weights: DataFrame, term: str, weight: str, k: int = 5) -> DataFrame:
    """For each dimension the documents with the least and the greatest value, with their k heaviest terms."""
    cells = vectors.select(doc, F.posexplode(vec).alias("dim", "x"))
    ends = cells.groupBy("dim").agg(
        F.min(F.struct("x", doc))[doc].alias("least"),
        F.max(F.struct(F.col("x"), (-F.col(doc)).alias("neg"), F.col(doc).alias("d")))["d"].alias("greatest"),
    )
    chosen = ends.select("dim", F.expr("stack(2, 'least', least, 'greatest', greatest) as (side, doc)"))
    terms = weights.join(chosen.select(F.col("doc").alias(doc)).distinct(), doc, "left_semi")
    best = top_k(terms, [doc], [F.desc(weight), F.asc(term)], k)
    return chosen.join(best, chosen["doc"] == best[doc]).select("dim", "side", "doc", "rank", term)


def topk_idf_words(sets: DataFrame, keys: list[str], word: str, idf: DataFrame, k: int = 5) -> DataFrame:
    """The k rarest words of each (nested) word set: (set, subset, rank, word, idf)."""
    rows = sets.select(*keys, word).distinct().join(idf.select(word, "idf"), word)
    return top_k(rows, keys, [F.desc("idf"), F.asc(word)], k).select(*keys, "rank", word, "idf")


def topk_words_per_topic(weights: DataFrame, topic: str, word: str, weight: str, k: int) -> DataFrame:
    return top_k(weights, [topic], [F.desc(weight), F.asc(word)], k)


def topk_word_set(weights: DataFrame, topic: str, word: str, weight: str, k: int) -> DataFrame:
    """The heaviest words of all topics as one set."""
    return topk_words_per_topic(weights, topic, word, weight, k).select(word).distinct()


def similar_terms(sims: DataFrame, term: str, sim: str, out: str = "rescaled") -> DataFrame:
    """Terms by similarity to one term: a self match (similarity ≥ 1) is pushed to the
    minimum, the rest rescaled to 0–1 and sorted."""
    low = sims.agg(F.min(sim)).scalar()
    pushed = sims.withColumn(sim, F.when(F.col(sim) >= 1.0 - 1e-12, low).otherwise(F.col(sim)))
    return minmax_scale(pushed, sim, out).select(term, out).orderBy(F.desc(out), term)


def sort_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct().orderBy(label)


def ordered_matrix(pairs: DataFrame, i: str, j: str, dist: str, leaves: DataFrame, key: str, pos: str) -> DataFrame:
    """Cells of the permuted matrix: both keys replaced by their leaf position (row < col)."""
    a = leaves.select(F.col(key).alias(i), F.col(pos).alias("_r"))
    b = leaves.select(F.col(key).alias(j), F.col(pos).alias("_c"))
    return pairs.join(a, i).join(b, j).select(
        F.least("_r", "_c").alias("row"), F.greatest("_r", "_c").alias("col"), dist
    )


def uniform(key: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) from a key, independent of partitioning."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10)
    return h.cast("bigint") / F.lit(2.0**32)


def random_split(df: DataFrame, key: str, shares: list[float], seed: int = 1, out: str = "split") -> DataFrame:
    """Split number per row by a seeded hash of the key."""
    u, edge, expr = uniform(F.col(key), seed), 0.0, None
    for i, s in enumerate(shares[:-1]):
        edge += s
        expr = F.when(u < edge, i) if expr is None else expr.when(u < edge, i)
    last = F.lit(len(shares) - 1)
    return df.withColumn(out, (expr.otherwise(last) if expr is not None else last).cast("int"))


def shuffle_splits(df: DataFrame, key: str, n: int = 2, test: float = 0.1, seed: int = 1) -> DataFrame:
    """``n`` independent train/test splits, one column each (1 = test)."""
    for i in range(n):
        df = df.withColumn(f"test_{i}", (uniform(F.col(key), seed + i) < test).cast("int"))
    return df


def sample_three_sets(df: DataFrame, order: list[str], n: int = 300, sets: int = 3, seed: int = 1) -> DataFrame:
    """``n`` draws with replacement, cut into ``sets`` equal parts: (set, draw, row columns)."""
    pos = positions(df, [], order, "_pos")
    total = df.agg(F.count(F.lit(1))).scalar()
    draws = (
        df.sparkSession.range(n)
        .select(F.col("id").alias("draw"), F.floor(uniform(F.col("id"), seed) * total).alias("_pick"))
        .withColumn("_pick", F.col("_pick").cast("bigint") + 1)
    )
    # the draws are n rows by construction, so the table itself is not shuffled
    return pos.join(F.broadcast(draws), F.col("_pos") == F.col("_pick")).select(
        F.floor(F.col("draw") / (n // sets)).cast("int").alias("set"), "draw", *df.columns
    )


def author_disjoint_select(rows: DataFrame, key: str, rank: list[str], authors: DataFrame, author: str) -> DataFrame:
    """Walk ``rows`` by rank and keep a row if none of its authors was used by a kept row.

    The greedy walk is the lexicographically first independent set, so it can be found in
    rounds: an undecided row that is the lowest of every one of its authors is kept, all rows
    that share an author with it are dropped. Rows meet only through the per-author minimum;
    no pair of rows is ever formed. ``rank`` must be unique per row.
    """
    order = F.struct(*rank, key)
    todo = cut(rows.select(key, order.alias("_o")).join(authors.select(key, author).distinct(), key))
    loose = rows.join(authors.select(key).distinct(), key, "left_anti").select(key)
    kept = loose
    while not todo.isEmpty():
        first = todo.groupBy(author).agg(F.min("_o").alias("_first"))
        judged = todo.join(first, author)
        win = cut(
            judged.groupBy(key).agg(F.min((F.col("_o") == F.col("_first")).cast("int")).alias("_win"))
            .filter("_win = 1").select(key)
        )
        used = todo.join(win, key, "left_semi").select(author).distinct()
        gone = todo.join(used, author, "left_semi").select(key).distinct()
        kept = kept.unionByName(win)
        todo = cut(todo.join(gone, key, "left_anti"))
    return rows.join(kept, key, "left_semi")


def keyword_lists(rows: DataFrame, key: str, keyword: str, budget: int = 100, out: str = "keys") -> DataFrame:
    """Listed keywords per row, for the rows that list at most ``budget``.

    A longer list can never fit the budget, so it is left out before anything is collected.
    """
    fit = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= budget).select(key)
    return rows.join(fit, key, "left_semi").groupBy(key).agg(F.collect_list(keyword).alias(out))


def keyword_budget_select(rows: DataFrame, key: str, rank: str, keywords: str, budget: int = 100, batch: int = 500) -> DataFrame:
    """Walk rows by rank; keep a row if the distinct keywords so far plus this row's listed
    keywords (repeats counted) stay within the budget. A row that does not fit is skipped.

    The keyword set changes at most ``budget`` times. Each round fetches the next ``batch``
    lowest rows that fit and add a keyword; the first of them always changes the set, so there
    are at most ``budget`` rounds and never more than ``batch`` rows on the driver. Then every
    row is decided in parallel by the set in force at its rank (at most ``budget`` literals).
    """
    rows = rows.filter(F.size(keywords) > 0)
    added: dict[str, int] = {}
    takers: list[int] = []
    last = None
    while len(added) < budget:
        cand = rows.filter(F.size(keywords) <= budget - len(added))
        if last is not None:
            cand = cand.filter(F.col(rank) > last)
        if added:
            have = F.array(*[F.lit(w) for w in added])
            cand = cand.filter(F.size(F.array_except(keywords, have)) > 0)
        got = cand.select(rank, keywords).orderBy(rank).limit(batch).collect()
        for r, words in got:
            if len(added) + len(words) <= budget and not set(words) <= added.keys():
                for w in words:
                    added.setdefault(w, r)
                takers.append(r)
            last = r
        if len(got) < batch:
            break
    if not takers:
        return rows.limit(0)
    kind = rows.schema[rank].dataType
    since = F.create_map(*[x for w, r in added.items() for x in (F.lit(w), F.lit(r).cast(kind))])
    steps = F.array(*[F.lit(r).cast(kind) for r in added.values()])
    known = F.forall(keywords, lambda w: F.coalesce(F.try_element_at(since, w) < F.col(rank), F.lit(False)))
    size = F.size(F.filter(steps, lambda s: s < F.col(rank)))
    return rows.filter(F.col(rank).isin(*[F.lit(r).cast(kind) for r in takers]) | (known & (size + F.size(keywords) <= budget)))


def token_context_features(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """Per token its form flags, suffixes and the flags of both neighbours.

    The neighbours sit in the same row's token array, so nothing is shuffled.
    """
    base = df.select(*keys, tokens.alias("_t"))
    cells = base.select(*keys, "_t", F.posexplode("_t").alias("pos", "word"))

    def flags(w: Column) -> list[tuple[str, Column]]:
        return [
            ("is_lower", (F.lower(w) == w) & (F.upper(w) != w)),
            ("is_title", w.rlike(r"^\p{Lu}[^\p{Lu}]*$")),
            ("is_upper", (F.upper(w) == w) & (F.lower(w) != w)),
        ]

    own = [c.alias(n) for n, c in flags(F.col("word"))]
    prev = F.get("_t", F.col("pos") - 1)
    nxt = F.get("_t", F.col("pos") + 1)
    return cells.select(
        *keys, "pos", "word", *own,
        F.col("word").rlike("^[0-9]+$").alias("is_digit"),
        F.right("word", F.lit(2)).alias("suffix2"),
        F.right("word", F.lit(3)).alias("suffix3"),
        *[c.alias("prev_" + n) for n, c in flags(prev)],
        *[c.alias("next_" + n) for n, c in flags(nxt)],
        (F.col("pos") == 0).alias("bos"),
        (F.col("pos") == F.size("_t") - 1).alias("eos"),
    )
