"""The driver tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weft.functions.text import words
from weft.plans.registry import table
from weft.session import widen


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return widen(table(spark, sf, "documents"), "doc_id")


def corpus_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, w): one row per token occurrence."""
    return corpus(spark, sf).select("doc_id", F.explode(words(F.col("text"))).alias("w"))


TOKENS_SQL = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM documents)"


def song_tags(spark: SparkSession, sf: str) -> DataFrame:
    """(song, linenumber, partkey, suppkey, tag)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("song"), "l_linenumber", "l_partkey", "l_suppkey", F.col("p_name").alias("tag")
    )


SONG_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "tag"]
SONG_SQL = """st AS (SELECT l_orderkey AS song, l_linenumber, l_partkey, l_suppkey, p_name AS tag
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def publications(spark: SparkSession, sf: str) -> DataFrame:
    """(pub, year, keyword, author): a publication is an order, a keyword is a part on a line number."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_orderkey").alias("pub"),
        F.year("o_orderdate").alias("year"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("keyword"),
        F.col("l_suppkey").alias("author"),
    )


PUBS_SQL = """pubs AS (SELECT o_orderkey AS pub, CAST(year(o_orderdate) AS INTEGER) AS year,
    'p' || l_partkey || '-' || l_linenumber AS keyword, l_suppkey AS author
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """(keyword, label, seq)."""
    return table(spark, sf, "part").select(
        F.col("p_name").alias("keyword"), F.col("p_type").alias("label"), F.col("p_partkey").alias("seq")
    )


MAPPING_SQL = "mp AS (SELECT p_name AS keyword, p_type AS label, p_partkey AS seq FROM part)"


def annotator(spark: SparkSession, sf: str, m: int) -> DataFrame:
    """A mapping whose label is replaced where the sequence is a multiple of m."""
    return mapping(spark, sf).withColumn(
        "label", F.when(F.col("seq") % m == 0, F.lit("SMALL")).otherwise(F.col("label"))
    )


def exams(spark: SparkSession, sf: str) -> DataFrame:
    """(path_id, semester, course, grade, ects, event_id) from the events table."""
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    week = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    return ev.select(
        F.col("user_id").alias("path_id"),
        week.alias("semester"),
        F.concat("event_type", F.lit("_"), F.floor(k / 10).cast("string")).alias("course"),
        (k % 5 + 1).alias("grade"),
        F.col("value").alias("ects"),
        "event_id",
    )


EXAMS_SQL = """ex AS (SELECT user_id AS path_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS INTEGER) AS semester,
    event_type || '_' || CAST(CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 10) AS BIGINT) AS VARCHAR) AS course,
    CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1 AS grade, value AS ects, event_id FROM events)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, v ARRAY<DOUBLE>, label)."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), "label"
    )


def word_vector_id(spark: SparkSession, sf: str) -> Column:
    """The id of the stored vector that stands for the word ``w``: a hash of the whole word, so that every vector may be hit."""
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    return F.conv(F.substring(F.md5("w"), 1, 15), 16, 10).cast("bigint") % n


WORD_VECTOR_SQL = "(('0x' || substr(md5(w), 1, 15))::BIGINT % (SELECT count(*) FROM embeddings))"


VECS_SQL = "vx AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
