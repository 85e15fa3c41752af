"""Table-level text operators: tokens, lemmas, phrases, keyword tables, nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weft.functions.text import clean_tag_doc, normalise_mapping_field, singular, split_list
from weft.operators.order import ordered_chunks, positions
from weft.session import cut


def token_table(df: DataFrame, key: str, tokens: Column, word: str = "word", pos: str = "pos") -> DataFrame:
    """(key, pos, word): one row per token, 0-based positions."""
    return df.select(key, F.posexplode(tokens).alias(pos, word))


def lemma_lookup(tokens: DataFrame, word: str, lemmas: DataFrame, plurals: bool = False, out: str = "lemma") -> DataFrame:
    """Base form from a (word, lemma) table, else the word itself (or its plain singular), lower.

    A join by word; Spark broadcasts the table only when its measured size allows it.
    """
    rest = singular(F.lower(word)) if plurals else F.lower(word)
    pairs = lemmas.groupBy("word").agg(F.min("lemma").alias("_lemma")).withColumnRenamed("word", "_w")
    return (
        tokens.join(pairs, F.lower(word) == F.col("_w"), "left")
        .withColumn(out, F.lower(F.coalesce("_lemma", rest)))
        .drop("_w", "_lemma")
    )


def word_class_filter(tokens: DataFrame, word: str, classes: DataFrame, wanted: list[str]) -> DataFrame:
    """Keep words whose class in a (word, class) table is wanted."""
    ok = classes.filter(F.col("class").isin(wanted)).select(F.col("word").alias(word)).distinct()
    return tokens.join(ok, word, "left_semi")


def clean_tag_docs(df: DataFrame, keys: list[str], doc: str, part_size: int = 10_000) -> DataFrame:
    """Distinct cleaned tags per song, as a list and as one document: (keys, part, tags, doc).

    Tags are made distinct before they are put together, whatever number of rows a song has;
    a song with more than ``part_size`` tags has several parts.
    """
    tags = df.select(*keys, F.explode(split_list(clean_tag_doc(F.col(doc)), ".")).alias("tag")).distinct()
    return ordered_chunks(tags, keys, ["tag"], "tag", part_size, "tags").withColumn("doc", F.concat_ws(" ", "tags"))


def tag_sentences(cleaned: DataFrame, keys: list[str]) -> DataFrame:
    """The words of every tag: (keys, tag, word)."""
    return cleaned.select(*keys, F.explode("tags").alias("tag")).select(*keys, "tag", F.explode(F.split("tag", " ", -1)).alias("word"))


def normalise_mapping(mapping: DataFrame, keyword: str, label: str) -> DataFrame:
    return mapping.withColumns({c: normalise_mapping_field(F.col(c)) for c in (keyword, label)})


def keyword_label_map(rows: DataFrame, row: str, keyword: str, labels: DataFrame, label: str) -> DataFrame:
    """Keyword → all labels of the rows it occurs in: (keyword, label), distinct on both sides first."""
    k = rows.select(row, keyword).distinct()
    return k.join(labels.select(row, label).distinct(), row).select(keyword, label).distinct()


def keyword_in_text(df: DataFrame, key: str, keywords: str, fields: list[str], sep: str = " ; ") -> DataFrame:
    """Per key and keyword whether it is a substring of the joined fields. A key may have
    several rows (parts of a long text); a hit in any of them counts."""
    text = F.concat_ws(sep, *[F.lower(f) for f in fields])
    cells = df.select(key, text.alias("_t"), F.explode(keywords).alias("_k"))
    hits = cells.select(key, "_k", F.contains("_t", F.lower("_k")).cast("int").alias("_f"))
    return hits.groupBy(key, "_k").agg(F.max("_f").alias("_f")).select(
        key, F.lower("_k").alias("keyword"), (F.col("_f") == 1).alias("found")
    )


def keyword_in_text_counts(hits: DataFrame) -> DataFrame:
    per = hits.groupBy("keyword", "found").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").alias("n_total"),
        F.coalesce(F.sum(F.when(F.col("found"), F.col("n"))), F.lit(0)).alias("n_found"),
        F.count(F.when(F.col("found"), 1)).alias("distinct_found"),
        F.count(F.when(~F.col("found"), 1)).alias("distinct_not_found"),
    )


def word_tree(keywords: DataFrame, keyword: str) -> DataFrame:
    """Single word → multi-word keywords that contain it as a word: (root, child)."""
    k = keywords.select(F.lower(keyword).alias("k")).distinct()
    many = k.filter(F.contains("k", F.lit(" "))).select(
        F.col("k").alias("child"), F.explode(F.array_distinct(F.split("k", " ", -1))).alias("root")
    )
    roots = k.filter(~F.contains("k", F.lit(" "))).select(F.col("k").alias("root"))
    return many.join(roots, "root", "left_semi").select("root", "child")


def label_classes(labels: DataFrame, label: str) -> DataFrame:
    """(label, id): the distinct labels numbered from 0 in their order, written once. NULL is no label."""
    names = labels.select(F.col(label).alias("label")).filter("label IS NOT NULL").distinct()
    return cut(positions(names, [], ["label"], "_p").select("label", (F.col("_p") - 1).alias("id")))


def multilabel_encode(rows: DataFrame, key: str, label: str, classes: DataFrame, out: str = "ids") -> DataFrame:
    """(key, ids): the numbers of a row's labels, ascending and once each, from the long table (key, label).

    Labels outside ``classes``, and NULL, have no number; a row with only such labels keeps its place with no ids.
    """
    numbered = rows.select(key, F.col(label).alias("label")).join(classes, "label", "left")
    return numbered.groupBy(key).agg(F.array_sort(F.collect_set("id")).alias(out))


def multilabel_decode(encoded: DataFrame, key: str, ids: str, classes: DataFrame, sep: str = ";", out: str = "labels") -> DataFrame:
    """(key, labels): the names of a row's numbers, in their order, joined; an empty string for a row without any."""
    long = encoded.select(key, F.explode_outer(ids).alias("id")).join(classes, "id", "left")
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "label")))), lambda x: x["label"])
    return long.groupBy(key).agg(F.concat_ws(sep, named).alias(out))


def dense_bits(ids: str, width: int) -> Column:
    """The 0/1 vector of ``width`` classes from a row's numbers, as a string."""
    return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_contains(ids, i.cast("bigint")).cast("int").cast("string")))


def nested_enrich(df: DataFrame, record: str, paths: dict[str, str], cascade: bool = False) -> DataFrame:
    """Values out of a nested record by path, NULL if missing; ``[0]`` takes the first array element.

    ``cascade`` keeps the older behaviour in which a missing value empties all later columns.
    """
    def reach(path: str) -> Column:
        col, steps = None, path.split(".")
        for step in steps:
            name, _, idx = step.partition("[")
            col = F.col(f"{record}.{name}") if col is None else col.getField(name)
            if idx:
                col = F.get(col, int(idx.rstrip("]")))
        return col

    out, alive = [], F.lit(True)
    for name, path in paths.items():
        value = reach(path)
        out.append((F.when(alive, value) if cascade else value).alias(name))
        alive = alive & value.isNotNull()
    return df.select(*[c for c in df.columns if c != record], *out)
