"""Projections, filters, lookups, joins and aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weft.functions.text import split_list
from weft.operators.order import ordered_chunks, positions

# ---------------------------------------------------------------- projections and filters


def project_columns(df: DataFrame, keep: list[str] | None = None, drop: list[str] = ()) -> DataFrame:
    return df.select(*keep) if keep is not None else df.drop(*drop)


def rename_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """New names by position; columns after the last given name keep theirs."""
    return df.toDF(*names, *df.columns[len(names):])


def keep_every_second_row(df: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """Drop rows 0, 2, 4, … of the given order and keep the first ``n`` of the rest."""
    pos = positions(df, [], order, "_pos")
    kept = pos.filter(F.col("_pos") % 2 == 0)
    if n is not None:
        kept = kept.filter(F.col("_pos") <= 2 * n)
    return kept.drop("_pos")


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def fill_null(df: DataFrame, values: dict) -> DataFrame:
    return df.na.fill(values)


def filter_regex(df: DataFrame, column: str, pattern: str, complement: bool = False) -> DataFrame:
    """Rows that match, or all others; a NULL never matches, so it is in the complement."""
    hit = F.coalesce(F.col(column).cast("string").rlike(pattern), F.lit(False))
    return df.filter(~hit if complement else hit)


def derive_period_flag(df: DataFrame, column: str, marks: list[str], out: str = "period") -> DataFrame:
    arr = F.array(*[F.lit(m) for m in marks])
    hit = F.exists(arr, lambda m: F.contains(F.col(column).cast("string"), m))
    return df.withColumn(out, F.when(hit, "new").otherwise("old"))


def override_value(df: DataFrame, column: str, condition: Column, value) -> DataFrame:
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def slice_head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def count_band(df: DataFrame, count: str, out: str = "band") -> DataFrame:
    """``once`` (1), ``few`` (2–5) or ``many`` (more)."""
    c = F.col(count)
    return df.withColumn(out, F.when(c == 1, "once").when(c <= 5, "few").otherwise("many"))


# ---------------------------------------------------------------- lookups and joins


def normalised_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def normalised_key_lookup(
    df: DataFrame, name: str, translation: dict[str, str], facts: DataFrame, facts_key: str, out: str = "fact_key"
) -> DataFrame:
    """Normalise a name, translate it by a short literal list, left join the facts.

    ``matched`` says whether a record was found, so that unmatched keys can be reported.
    """
    key = normalised_key(F.col(name))
    if translation:
        pairs = [F.lit(x) for kv in translation.items() for x in kv]
        key = F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)
    hits = facts.withColumn("_hit", F.lit(True))
    return (
        df.withColumn(out, key)
        .join(hits, F.col(out) == hits[facts_key], "left")
        .withColumn("matched", F.col("_hit").isNotNull())
        .drop("_hit")
    )


def first_match(mapping: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The first mapping row per key wins: one partial aggregation, no window."""
    return mapping.groupBy(key).agg(F.min_by(value, seq).alias(value))


def first_match_lookup(df: DataFrame, key: str, mapping: DataFrame, map_key: str, value: str, seq: str) -> DataFrame:
    first = first_match(mapping, map_key, value, seq).withColumnRenamed(map_key, key)
    return df.join(first, key, "left")


def coalesce_two_mappings(
    df: DataFrame, key: str, local: DataFrame, global_: DataFrame, map_key: str, value: str, seq: str, out: str = "label"
) -> DataFrame:
    """The label of a local mapping, else that of a global one."""
    a = first_match(local, map_key, value, seq).toDF(key, "_local")
    b = first_match(global_, map_key, value, seq).toDF(key, "_global")
    return (
        df.join(a, key, "left").join(b, key, "left")
        .withColumn(out, F.coalesce("_local", "_global"))
        .drop("_local", "_global")
    )


def annotation_sheet(keywords: DataFrame, key: str, mapping: DataFrame, map_key: str, value: str, seq: str) -> DataFrame:
    chosen = keywords.select(key).distinct()
    return (
        first_match_lookup(chosen, key, mapping, map_key, value, seq)
        .select(key, F.lit("").alias("label"), F.lit("").alias("time"), F.col(value).alias("truth"))
    )


def multi_way_equi_join(frames: list[DataFrame], key: str | list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key), frames)


def positional_align(frames: list[DataFrame], key: str) -> DataFrame:
    """Result tables side by side, aligned on their stored row key."""
    return multi_way_equi_join(frames, key)


def annotator_align(sources: dict[str, DataFrame], key: str, value: str, seq: str) -> DataFrame:
    """One row per keyword with the first label of every source.

    The sources are stacked and folded in one aggregation, instead of one join per source.
    """
    stacked = reduce(
        DataFrame.unionByName,
        [d.select(key, value, seq, F.lit(name).alias("_src")) for name, d in sources.items()],
    )
    cols = [
        F.min_by(F.when(F.col("_src") == n, F.col(value)), F.when(F.col("_src") == n, F.col(seq))).alias(n)
        for n in sources
    ]
    first = next(iter(sources))
    return stacked.groupBy(key).agg(*cols).filter(F.col(first).isNotNull())


def neighbour_stats_join(similar: DataFrame, counts: DataFrame, key: str, n: int, by: str) -> DataFrame:
    """The n most similar terms joined to their counts."""
    top = similar.orderBy(F.desc(by), key).limit(n)
    return top.join(counts, key)


def novel_keywords(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    return test.select(key).distinct().join(train.select(key).distinct(), key, "left_anti")


def mapping_excluding(mapping: DataFrame, key: str, excluded: DataFrame) -> DataFrame:
    return mapping.join(excluded.select(key).distinct(), key, "left_anti")


def unmapped_keywords(keywords: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    return keywords.select(key).distinct().join(mapping.select(key).distinct(), key, "left_anti")


def rows_with_any_key(df: DataFrame, row: str, exploded: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows with at least one key in the wanted set."""
    hits = exploded.join(wanted.select(key).distinct(), key, "left_semi").select(row).distinct()
    return df.join(hits, row, "left_semi")


# ---------------------------------------------------------------- aggregations


def null_profile(df: DataFrame) -> DataFrame:
    """Non-NULL count per column, and the number of rows; one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in df.columns])


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column.

    Exact counting first removes repeats per column by a hash aggregation; several
    ``countDistinct`` in one aggregate would expand every row once per column as well,
    and leave the final count of each column to one task's row stream.
    """
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns])
    entries = F.explode(
        F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    )
    seen = df.select(entries.alias("e")).select("e.c", "e.v").filter(F.col("v").isNotNull()).distinct()
    return seen.agg(*[F.count(F.when(F.col("c") == c, 1)).alias(f"n_{c}") for c in columns])


def group_concat_docs(df: DataFrame, key: str, value: str, order: list[str], sep: str = ".", part_size: int = 10_000) -> DataFrame:
    """One document per key: its values joined in order.

    A key with more than ``part_size`` values gets several rows (``part`` 0, 1, …), so that
    no group is held in one cell; the parts joined by ``sep`` are the whole document.
    """
    return ordered_chunks(df, [key], order, value, part_size).select(
        key, "part", F.concat_ws(sep, "items").alias("doc")
    )


def group_count(df: DataFrame, key: str | list[str], out: str = "n") -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def keyword_length_histogram(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    keys = df.select(F.explode(split_list(F.col(column), sep)).alias("k"))
    return keys.groupBy(F.size(F.split("k", " ", -1)).alias("n_words")).agg(F.count(F.lit(1)).alias("n"))


def value_histogram(df: DataFrame, cls: str, x: str, n_bins: int, unique: bool = False) -> DataFrame:
    """Counts in bins of width 1 between 0 and ``n_bins`` per class; the class ``all`` is left out."""
    rows = df.filter((F.col(cls).cast("string") != "all") & (F.col(x) >= 0) & (F.col(x) < n_bins))
    rows = rows.select(cls, x)
    if unique:
        rows = rows.distinct()
    return rows.groupBy(cls, F.floor(x).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def cluster_counts_per_doc(words: DataFrame, doc: str, cluster: str, k: int) -> DataFrame:
    """Words per document per cluster 0..k−1, zero filled.

    Each document's zero rows come from its own sequence of clusters, not from a product of tables.
    """
    counts = words.groupBy(doc, cluster).agg(F.count(F.lit(1)).alias("n"))
    per_doc = counts.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct(cluster, "n"))).alias("_m"))
    return per_doc.select(doc, "_m", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(cluster)).select(
        doc, cluster, F.coalesce(F.try_element_at("_m", F.col(cluster)), F.lit(0)).cast("bigint").alias("n")
    )


def doc_cluster_distribution(counts: DataFrame, doc: str, n: str, out: str = "share") -> DataFrame:
    """Counts minus the document's minimum, divided by their sum; NULL when the sum is zero."""
    w = W.partitionBy(doc)
    low = F.min(n).over(w)
    total = F.sum(n).over(w) - low * F.count(F.lit(1)).over(w)
    return counts.withColumn(out, F.when(total > 0, (F.col(n) - low) / total))


def group_by_label_members(df: DataFrame, label: str, member: str) -> DataFrame:
    """Members of every class plus the class ``all``, as a long table; a NULL label is a class of its own."""
    both = F.array(F.col(label).cast("string"), F.lit("all"))
    return df.select(F.explode(both).alias("class"), member)


def label_sizes(df: DataFrame, label: str) -> DataFrame:
    """Members per class (NULL included) and one row for all classes together."""
    name = F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(label).cast("string"))
    sizes = df.rollup(label).agg(F.count(F.lit(1)).alias("n"), F.grouping(label).alias("_all"))
    return sizes.select(name.alias("class"), "n")


def index_documents(tokens: DataFrame, word: str, vectors: DataFrame, vec: str) -> DataFrame:
    """Every word occurrence of every document with the word's vector, in whatever form ``vectors`` holds it.

    The vectors are the hashed side of the join: occurrences are neither sorted nor spilled, and those of a hot word are dealt out.
    """
    return tokens.join(vectors.select(word, vec).hint("shuffle_hash"), word)


def label_set_counts(docs: DataFrame, labels: str, wanted: str | None = None) -> DataFrame:
    """Documents per distinct label set (restricted to documents that have ``wanted``)."""
    rows = docs if wanted is None else docs.filter(F.array_contains(labels, wanted))
    return rows.groupBy(F.array_sort(F.array_distinct(labels)).alias("labels")).agg(F.count(F.lit(1)).alias("n_docs"))


def label_set_summary(docs: DataFrame, labels: str, wanted: str | None = None, max_sets: int = 40, max_labels: int = 20) -> DataFrame:
    """Documents, labels and sets, and whether the set plot would be refused as too large."""
    sets = label_set_counts(docs, labels, wanted)
    per = sets.select("n_docs", F.size("labels").alias("_k"))
    n_labels = sets.select(F.explode("labels").alias("l")).distinct().agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.count(F.lit(1)).alias("n_sets")
    ).withColumn("n_labels", n_labels.scalar())
    return out.withColumn("refused", (F.col("n_sets") > max_sets) | (F.col("n_labels") > max_labels))


def median_of_runs(df: DataFrame, keys: list[str], x: str, out: str = "median") -> DataFrame:
    """The median of ``x`` per key: the middle one or two of its ordered values, so a key may hold any share of the rows."""
    values = positions(df.filter(F.col(x).isNotNull()).select(*keys, x), keys, [x], "_p")
    names = [f"_k{i}" for i in range(len(keys))]
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).toDF(*names, "_n")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    middle = values.join(sizes, same).filter(F.col("_p").isin(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1))
    return middle.groupBy(*keys).agg(F.avg(x).alias(out))


def minmax_scale(df: DataFrame, x: str, out: str) -> DataFrame:
    """(x − min) / (max − min); the two limits are a one-row scalar subquery."""
    s = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s")).scalar()
    lo, hi = s.getField("lo"), s.getField("hi")
    return df.withColumn(out, F.when(hi > lo, (F.col(x) - lo) / (hi - lo)))


def max_scale(df: DataFrame, x: str, out: str) -> DataFrame:
    top = df.agg(F.max(x)).scalar()
    return df.withColumn(out, F.when(top != 0, F.col(x) / top))


def abs_error_summary(pairs: DataFrame, truth: DataFrame, keys: list[str], dist: str, true: str, n_items: int | Column | None = None) -> DataFrame:
    """Mean and sum of abs(distance − truth) over the pairs i < j; the full symmetric
    matrix has twice the sum and, with its zero diagonal, n² cells."""
    err = F.abs(F.col(dist) - F.col(true))
    out = pairs.join(truth, keys).agg(
        F.avg(err).alias("mean_abs"), F.sum(err).alias("sum_abs"), F.count(F.lit(1)).alias("n_pairs")
    )
    if n_items is not None:
        n = n_items if isinstance(n_items, Column) else F.lit(n_items)
        out = out.withColumn("matrix_sum", 2 * F.col("sum_abs")).withColumn("matrix_mean", 2 * F.col("sum_abs") / (n * n))
    return out


def append_rows(frames: dict[str, DataFrame], source: str = "source") -> DataFrame:
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [d.withColumn(source, F.lit(name)) for name, d in frames.items()],
    )
