"""Queries for readers, writers and generated tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from weft.functions.text import words
from weft.operators.skipgram import SkipGram
from weft.plans.registry import query, table
from weft.plans.roles import corpus, vectors
from weft.session import scratch_path
from weft.sources import html, tables

PART_SCHEMA = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("scan_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def scan_csv(spark, sf):
    path = scratch_path(spark, "part.csv")
    tables.sink_csv(table(spark, sf, "part"), path, sep=";")
    return tables.scan_csv(spark, path, PART_SCHEMA, sep=";")


@query("scan_json_index", "SELECT p_partkey AS idx, p_name, p_size, p_retailprice FROM part")
def scan_json_index(spark, sf):
    path = scratch_path(spark, "part.json")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), "p_name", "p_size", "p_retailprice")
    tables.sink_json_index(rows, path, "idx")
    return tables.scan_json_index(spark, path, "p_name: string, p_size: int, p_retailprice: double")


@query("scan_table", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def scan_table(spark, sf):
    got = tables.scan_table(spark, f"{sf}/orders.parquet", [F.desc("o_totalprice"), "o_orderkey"], 50)
    return got.select("o_orderkey", "o_custkey", "o_totalprice")


@query("scan_vectors", """SELECT vec_id, CAST(i - 1 AS INTEGER) AS k, round(CAST(embedding[i] AS DOUBLE), 6) AS x
  FROM embeddings, range(1, 65) r(i)""")
def scan_vectors(spark, sf):
    v = tables.scan_vectors(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding")
    return v.select("vec_id", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.round("x", 6))


@query("corpus_by_category", """SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS INTEGER) AS label, n_chars
  FROM documents WHERE lang IN ('en', 'fr', 'de')""")
def corpus_by_category(spark, sf):
    groups = {"english": F.col("lang") == "en", "other": F.col("lang").isin("fr", "de")}
    return tables.corpus_by_category(corpus(spark, sf), groups).select("doc_id", "label", "n_chars")


@query("sink_csv", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sink_csv(spark, sf):
    path = scratch_path(spark, "supplier.csv")
    tables.sink_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, header=False)
    return tables.scan_csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double", header=False)


@query("sink_json", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def sink_json(spark, sf):
    path = scratch_path(spark, "customer.json")
    nested = table(spark, sf, "customer").select("c_custkey", F.struct("c_name", "c_nationkey", "c_acctbal").alias("rec"))
    tables.sink_json(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select("c_custkey", "rec.*")


@query("sink_vectors_keyed", "SELECT vec_id, " + ", ".join(f"round(CAST(embedding[{k + 1}] AS DOUBLE), 6) AS v{k}" for k in range(64)) + " FROM embeddings")
def sink_vectors_keyed(spark, sf):
    path = scratch_path(spark, "vectors.csv")
    tables.sink_vectors_keyed(vectors(spark, sf), path, "vec_id", "v", 64)
    schema = "vec_id bigint, " + ", ".join(f"v{k} double" for k in range(64))
    back = tables.scan_csv(spark, path, schema)
    return back.select("vec_id", *[F.round(f"v{k}", 6).alias(f"v{k}") for k in range(64)])


@query("sink_text", r"""SELECT array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), ' ') AS line
  FROM documents WHERE len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) > 0""")
def sink_text(spark, sf):
    path = scratch_path(spark, "corpus.txt")
    toks = corpus(spark, sf).select(words(F.col("text")).alias("t")).filter(F.size("t") > 0)
    tables.sink_text(toks, path, "t")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("model_save_load", r"""SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word, 8 AS dim, true AS same FROM documents""")
def model_save_load(spark, sf):
    docs = corpus(spark, sf).select(words(F.col("text")).alias("t"))
    stage = SkipGram("t", dim=8, window=5, min_count=1, seed=1, max_iter=1)
    path = scratch_path(spark, "model")
    fitted = Pipeline(stages=[stage]).fit(docs)
    fitted.write().save(path)
    named = lambda model, name: model.stages[0].getVectors().select("word", vector_to_array("vector").alias(name))
    both = named(PipelineModel.load(path), "vector").join(named(fitted, "before"), "word", "left")
    return both.select("word", F.size("vector").alias("dim"), F.col("vector").eqNullSafe(F.col("before")).alias("same"))


@query("html_extract", r"""SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, trim(regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(raw, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text
  FROM (SELECT page_id, unnest(m) AS raw, generate_subscripts(m, 1) AS pos
    FROM (SELECT page_id, regexp_extract_all(html, '(?s)<div class="ad"[^>]*>(.*?)</div>', 1) AS m FROM pages))""")
def html_extract(spark, sf):
    return html.html_extract(table(spark, sf, "pages"), "page_id", "html", "div", "ad")


@query("html_links", r"""SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, link, regexp_extract(link, '([^/]*)$', 1) AS file
  FROM (SELECT page_id, unnest(m) AS link, generate_subscripts(m, 1) AS pos
    FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS m FROM pages))
  WHERE regexp_matches(link, '^/[a-z]') AND ends_with(link, 'e')""")
def html_links(spark, sf):
    return html.html_links(table(spark, sf, "pages"), "page_id", "html", "^/[a-z]", "e")


@query("contains_text_watch", r"""SELECT page_id, url, 'oiç' AS term FROM (SELECT page_id, url,
    trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages)
  WHERE contains(text, 'oiç')""")
def contains_text_watch(spark, sf):
    return html.contains_text_watch(table(spark, sf, "pages"), "page_id", "url", "html", "oiç")
