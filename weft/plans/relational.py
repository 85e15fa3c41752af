"""Queries for projections, filters, joins, lookups and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import remove_value, words
from weft.operators import relational as R
from weft.operators.order import ordered_chunks
from weft.operators.pairwise import abs_error_blocks
from weft.plans.registry import query, table
from weft.plans.roles import (
    WORD_VECTOR_SQL, word_vector_id,
    MAPPING_SQL, PUBS_SQL, SONG_ORDER, SONG_SQL, TOKENS_SQL, VECS_SQL, annotator, corpus, corpus_tokens, mapping,
    publications, song_tags, vectors,
)
from weft.session import cut

# ---------------------------------------------------------------- projections and filters


@query("project_columns", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def project_columns(spark, sf):
    return R.project_columns(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_quantity"])


@query("rename_columns", "SELECT s_suppkey AS key, s_name AS name, s_nationkey, s_acctbal FROM supplier")
def rename_columns(spark, sf):
    return R.rename_columns(table(spark, sf, "supplier"), ["key", "name"])


@query("keep_every_second_row", """SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey,
    row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn % 2 = 0 AND rn <= 2 * 2737""")
def keep_every_second_row(spark, sf):
    return R.keep_every_second_row(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 2737)


@query("drop_incomplete", """SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
  WHERE quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL""")
def drop_incomplete(spark, sf):
    both = corpus(spark, sf).select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return R.drop_incomplete(both).select("doc_id", "lang", "quality", "toxic")


@query("fill_null", """SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic
  FROM documents LEFT JOIN labels USING (doc_id)""")
def fill_null(spark, sf):
    both = corpus(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return R.fill_null(both, {"quality": -1, "toxic": 0}).select("doc_id", "quality", "toxic")


@query("filter_regex", """SELECT o_orderkey, 'match' AS side FROM orders WHERE regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '1997|1998|1999')
  UNION ALL SELECT o_orderkey, 'rest' FROM orders WHERE NOT regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '1997|1998|1999')""")
def filter_regex(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    pattern = "1997|1998|1999"
    hit = R.filter_regex(o, "d", pattern).select("o_orderkey", F.lit("match").alias("side"))
    return hit.unionByName(R.filter_regex(o, "d", pattern, True).select("o_orderkey", F.lit("rest").alias("side")))


@query("derive_period_flag", """SELECT o_orderkey, CASE WHEN contains(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '2000')
    OR contains(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '2001') THEN 'new' ELSE 'old' END AS period FROM orders""")
def derive_period_flag(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return R.derive_period_flag(o, "d", ["2000", "2001"]).select("o_orderkey", "period")


@query("remove_value_from_list", """WITH r AS (SELECT user_id, date_trunc('hour', ts) AS h, event_id, event_type,
    row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id) - 1 AS p FROM events),
  g AS (SELECT user_id, h, CAST(p // 1000 AS BIGINT) AS part, string_agg(event_type, ';' ORDER BY event_id) AS s FROM r GROUP BY ALL)
  SELECT user_id, h AS hour, part, array_to_string(list_filter(string_split(s, ';'), lambda x: x <> 'error'), ';') AS kinds FROM g""")
def remove_value_from_list(spark, sf):
    ev = table(spark, sf, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour"), "event_id", "event_type")
    lists = ordered_chunks(ev, ["user_id", "hour"], ["event_id"], "event_type", 1000)
    return lists.select("user_id", "hour", "part", remove_value(F.concat_ws(";", "items"), "error").alias("kinds"))


@query("override_value", """SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'MACHINERY' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def override_value(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return R.override_value(c, "c_mktsegment", F.col("c_nationkey") == 3, "MACHINERY").drop("c_nationkey")


@query("slice_head", "SELECT event_id, user_id, value FROM events ORDER BY ts, event_id LIMIT 1000")
def slice_head(spark, sf):
    return R.slice_head(table(spark, sf, "events"), ["ts", "event_id"], 1000).select("event_id", "user_id", "value")


@query("count_band_filter", f"""WITH {TOKENS_SQL}, c AS (SELECT w, count(*) AS n FROM tok GROUP BY w)
  SELECT w, n, CASE WHEN n = 1 THEN 'once' WHEN n <= 5 THEN 'few' ELSE 'many' END AS band FROM c""")
def count_band_filter(spark, sf):
    return R.count_band(R.group_count(corpus_tokens(spark, sf), "w"), "n")


# ---------------------------------------------------------------- joins and lookups

# Names that differ between the two sources.
TRANSLATION = {"nation_3": "nation_four", "nation_7": "nation_1"}


def nation_facts(spark, sf):
    """Facts by nation: key, supplier count, total balance; some nations are missing."""
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("n_suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance")
    )
    return s.filter(F.col("s_nationkey") > 2).select(
        F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("fact"), "n_suppliers", "balance"
    )


@query("normalised_key_lookup", """WITH f AS (SELECT 'nation_' || s_nationkey AS fact, count(*) AS n_suppliers, round(sum(s_acctbal), 2) AS balance
    FROM supplier WHERE s_nationkey > 2 GROUP BY s_nationkey),
  k AS (SELECT c_custkey, CASE lower(replace(n_name, ' ', '_')) WHEN 'nation_3' THEN 'nation_four' WHEN 'nation_7' THEN 'nation_1'
    ELSE lower(replace(n_name, ' ', '_')) END AS fact_key FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT c_custkey, fact_key, n_suppliers, balance, fact IS NOT NULL AS matched FROM k LEFT JOIN f ON fact_key = fact""")
def normalised_key_lookup(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    got = R.normalised_key_lookup(c, "n_name", TRANSLATION, nation_facts(spark, sf), "fact")
    return got.select("c_custkey", "fact_key", "n_suppliers", "balance", "matched")


FIRST_SQL = "SELECT keyword, arg_min(label, seq) AS label FROM {m} GROUP BY keyword"


@query("first_match_lookup", f"""WITH {SONG_SQL}, {MAPPING_SQL}, f AS ({FIRST_SQL.format(m='mp')})
  SELECT song, l_linenumber, tag, label FROM st LEFT JOIN f ON tag = keyword""")
def first_match_lookup(spark, sf):
    tags = song_tags(spark, sf).select("song", "l_linenumber", F.col("tag").alias("keyword"))
    got = R.first_match_lookup(tags, "keyword", mapping(spark, sf), "keyword", "label", "seq")
    return got.select("song", "l_linenumber", F.col("keyword").alias("tag"), "label")


@query("coalesce_two_mappings", f"""WITH {SONG_SQL}, {MAPPING_SQL}, g AS ({FIRST_SQL.format(m='mp')}),
  lo AS (SELECT keyword, arg_min('local ' || label, seq) AS label FROM mp WHERE seq % 3 = 0 AND keyword < 'n' GROUP BY keyword)
  SELECT song, l_linenumber, tag, coalesce(lo.label, g.label) AS label FROM st LEFT JOIN lo ON tag = lo.keyword LEFT JOIN g ON tag = g.keyword""")
def coalesce_two_mappings(spark, sf):
    tags = song_tags(spark, sf).select("song", "l_linenumber", "tag")
    local = mapping(spark, sf).filter((F.col("seq") % 3 == 0) & (F.col("keyword") < "n")).withColumn("label", F.concat(F.lit("local "), "label"))
    return R.coalesce_two_mappings(tags, "tag", local, mapping(spark, sf), "keyword", "label", "seq")


@query("annotation_sheet", f"""WITH {SONG_SQL}, {MAPPING_SQL}, f AS ({FIRST_SQL.format(m='mp')})
  SELECT DISTINCT tag AS keyword, '' AS label, '' AS time, label AS truth FROM st LEFT JOIN f ON tag = keyword""")
def annotation_sheet(spark, sf):
    tags = song_tags(spark, sf).select(F.col("tag").alias("keyword"))
    return R.annotation_sheet(tags, "keyword", mapping(spark, sf), "keyword", "label", "seq")


@query("multi_way_equi_join", """SELECT a.k AS partkey, n_lines, qty, n_supp FROM (SELECT l_partkey AS k, count(*) AS n_lines FROM lineitem GROUP BY 1) a
  JOIN (SELECT l_partkey AS k, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) b ON a.k = b.k
  JOIN (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n_supp FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) c ON a.k = c.k""")
def multi_way_equi_join(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "partkey")
    a = li.groupBy("partkey").agg(F.count(F.lit(1)).alias("n_lines"))
    b = li.groupBy("partkey").agg(F.sum("l_quantity").alias("qty"))
    c = li.filter("l_returnflag = 'A'").groupBy("partkey").agg(F.countDistinct("l_suppkey").alias("n_supp"))
    return R.multi_way_equi_join([a, b, c], "partkey")


@query("positional_align", """SELECT doc_id, lang, quality, length(text) AS len FROM documents JOIN labels USING (doc_id)""")
def positional_align(spark, sf):
    d = corpus(spark, sf)
    frames = [d.select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality"),
              d.select("doc_id", F.length("text").cast("bigint").alias("len"))]
    return R.positional_align(frames, "doc_id")


def small_if(m):
    return f"SELECT keyword, CASE WHEN seq % {m} = 0 THEN 'SMALL' ELSE label END AS label, seq FROM mp"


@query("annotator_align", f"""WITH {MAPPING_SQL}, a3 AS ({small_if(3)}), a5 AS ({small_if(5)}),
  t AS ({FIRST_SQL.format(m='mp')}), x AS ({FIRST_SQL.format(m='a3')}), y AS ({FIRST_SQL.format(m='a5')})
  SELECT t.keyword AS keyword, t.label AS truth, x.label AS ann3, y.label AS ann5 FROM t JOIN x USING (keyword) JOIN y USING (keyword)""")
def annotator_align(spark, sf):
    sources = {"truth": mapping(spark, sf), "ann3": annotator(spark, sf, 3), "ann5": annotator(spark, sf, 5)}
    return R.annotator_align(sources, "keyword", "label", "seq")


NOVEL_SQL = f"""{PUBS_SQL}, novel AS (SELECT DISTINCT keyword FROM pubs WHERE year >= 1999
  AND keyword NOT IN (SELECT keyword FROM pubs WHERE year < 1999))"""


@query("novel_keywords_anti", f"WITH {NOVEL_SQL} SELECT keyword FROM novel")
def novel_keywords_anti(spark, sf):
    p = publications(spark, sf)
    return R.novel_keywords(p.filter("year >= 1999"), p.filter("year < 1999"), "keyword")


@query("mapping_excluding_anti", f"""WITH {MAPPING_SQL} SELECT keyword, label, seq FROM mp
  WHERE keyword NOT IN (SELECT p_name FROM part WHERE p_size > 49)""")
def mapping_excluding_anti(spark, sf):
    gone = table(spark, sf, "part").filter("p_size > 49").select(F.col("p_name").alias("keyword"))
    return R.mapping_excluding(mapping(spark, sf), "keyword", gone)


@query("unmapped_keywords", f"""WITH {TOKENS_SQL} SELECT DISTINCT w FROM tok WHERE w NOT IN
  (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) FROM benchmark)""")
def unmapped_keywords(spark, sf):
    known = table(spark, sf, "benchmark").select(F.explode(words(F.col("text"))).alias("w"))
    return R.unmapped_keywords(corpus_tokens(spark, sf), "w", known)


@query("rows_with_any_key_semi", f"""WITH {NOVEL_SQL} SELECT DISTINCT pub, year FROM pubs WHERE keyword IN (SELECT keyword FROM novel)""")
def rows_with_any_key_semi(spark, sf):
    p = publications(spark, sf)
    novel = R.novel_keywords(p.filter("year >= 1999"), p.filter("year < 1999"), "keyword")
    return R.rows_with_any_key(p.select("pub", "year").distinct(), "pub", p.select("pub", "keyword"), "keyword", novel)


# ---------------------------------------------------------------- aggregations


@query("null_profile", """SELECT count(*) AS n_rows, count(doc_id) AS n_doc_id, count(lang) AS n_lang, count(quality) AS n_quality,
  count(toxic) AS n_toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def null_profile(spark, sf):
    both = corpus(spark, sf).select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return R.null_profile(both)


@query("distinct_counts", """SELECT count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_partkey) AS n_l_partkey,
  count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem""")
def distinct_counts(spark, sf):
    return R.distinct_counts(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


@query("group_concat_docs", f"""WITH {SONG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY l_linenumber, l_partkey, l_suppkey, tag) - 1 AS p FROM st)
  SELECT song, CAST(p // 10000 AS BIGINT) AS part, string_agg(tag, '.' ORDER BY p) AS doc FROM r GROUP BY song, p // 10000""")
def group_concat_docs(spark, sf):
    return R.group_concat_docs(song_tags(spark, sf), "song", "tag", SONG_ORDER)


@query("group_count", f"WITH {SONG_SQL} SELECT tag, count(*) AS n FROM st GROUP BY tag")
def group_count(spark, sf):
    return R.group_count(song_tags(spark, sf), "tag")


@query("keyword_length_histogram", """WITH k AS (SELECT unnest(string_split(replace(replace(p_name || ';' || p_brand || ' x;;' || p_type, '#', ' '), ',', ''), ';')) AS k FROM part)
  SELECT CAST(len(string_split(k, ' ')) AS INTEGER) AS n_words, count(*) AS n FROM k WHERE k <> '' GROUP BY 1""")
def keyword_length_histogram(spark, sf):
    p = table(spark, sf, "part").select(
        F.translate(F.concat("p_name", F.lit(";"), "p_brand", F.lit(" x;;"), "p_type"), "#", " ").alias("keys")
    )
    return R.keyword_length_histogram(p, "keys")


@query("value_histogram", """SELECT event_type, CAST(floor(value) AS BIGINT) AS bin, count(DISTINCT value) AS n FROM events
  WHERE value >= 0 AND value < 40 GROUP BY ALL""")
def value_histogram(spark, sf):
    return R.value_histogram(table(spark, sf, "events"), "event_type", "value", 40, unique=True)


@query("cluster_counts_per_doc", f"""WITH {TOKENS_SQL}, c AS (SELECT doc_id, length(w) % 6 AS cluster, count(*) AS n FROM tok GROUP BY ALL)
  SELECT d.doc_id AS doc_id, CAST(k AS INTEGER) AS cluster, coalesce(n, 0) AS n FROM (SELECT DISTINCT doc_id FROM tok) d, range(0, 6) r(k)
  LEFT JOIN c ON c.doc_id = d.doc_id AND c.cluster = k""")
def cluster_counts_per_doc(spark, sf):
    return R.cluster_counts_per_doc(word_clusters(spark, sf), "doc_id", "cluster", 6)


def word_clusters(spark, sf):
    return corpus_tokens(spark, sf).select("doc_id", "w", (F.length("w") % 6).alias("cluster"))


DIST_SQL = f"""{TOKENS_SQL}, c AS (SELECT doc_id, length(w) % 6 AS cluster, count(*) AS n FROM tok GROUP BY ALL),
  z AS (SELECT d.doc_id AS doc_id, CAST(k AS INTEGER) AS cluster, coalesce(n, 0) AS n FROM (SELECT DISTINCT doc_id FROM tok) d, range(0, 6) r(k)
  LEFT JOIN c ON c.doc_id = d.doc_id AND c.cluster = k),
  m AS (SELECT doc_id, min(n) AS lo, sum(n) AS s, count(*) AS k FROM z GROUP BY doc_id)"""


@query("doc_cluster_distribution", f"""WITH {DIST_SQL} SELECT z.doc_id AS doc_id, cluster, n,
  round(CASE WHEN s - lo * k > 0 THEN (n - lo)::DOUBLE / (s - lo * k)::DOUBLE END, 6) AS share FROM z JOIN m ON z.doc_id = m.doc_id""")
def doc_cluster_distribution(spark, sf):
    counts = R.cluster_counts_per_doc(word_clusters(spark, sf), "doc_id", "cluster", 6)
    return R.doc_cluster_distribution(counts, "doc_id", "n").withColumn("share", F.round("share", 6))


@query("group_by_label_members", """SELECT CAST(label AS VARCHAR) AS class, vec_id, cnt FROM embeddings
    JOIN (SELECT label AS l, count(*) AS cnt FROM embeddings GROUP BY 1) ON l IS NOT DISTINCT FROM label
  UNION ALL SELECT 'all', vec_id, (SELECT count(*) FROM embeddings) FROM embeddings""")
def group_by_label_members(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    members = R.group_by_label_members(e, "label", "vec_id")
    sizes = R.label_sizes(e, "label").select(F.col("class").alias("_c"), F.col("n").alias("cnt"))
    return members.join(sizes, F.col("class").eqNullSafe(F.col("_c"))).drop("_c")


@query("index_documents", r"""WITH t AS (SELECT doc_id, unnest(m) AS w, generate_subscripts(m, 1) - 1 AS pos FROM
    (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS m FROM documents))
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, w, array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',') AS v
  FROM t JOIN embeddings ON vec_id = {WORD_VECTOR_SQL}""".replace("{WORD_VECTOR_SQL}", WORD_VECTOR_SQL))
def index_documents(spark, sf):
    toks = corpus(spark, sf).select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "w"))
    toks = toks.withColumn("vec_id", word_vector_id(spark, sf))
    # a vector is written as text once, not once per occurrence of its word
    millionths = F.transform("v", lambda x: F.round(x * 1000000).cast("bigint").cast("string"))
    known = cut(vectors(spark, sf).select("vec_id", F.concat_ws(",", millionths).alias("v")))
    return R.index_documents(toks, "vec_id", known, "v").select("doc_id", "pos", "w", "v")


def order_labels(spark, sf):
    """(song, labels): the set of part types of every order."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("song"), "l_partkey")
    part = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("label"))
    return li.join(part, li.l_partkey == part.p_partkey).select("song", "label").distinct()


SETS_SQL = """ol AS (SELECT DISTINCT l_orderkey AS song, p_type AS label FROM lineitem JOIN part ON l_partkey = p_partkey),
  sets AS (SELECT song, string_agg(label, ';' ORDER BY label) AS labels, list_sort(list(label)) AS arr FROM ol GROUP BY song)"""


def label_sets(spark, sf):
    return order_labels(spark, sf).groupBy("song").agg(F.array_sort(F.collect_list("label")).alias("labels"))


@query("label_set_counts", f"""WITH {SETS_SQL}, s AS (SELECT labels, count(*) AS n_docs FROM sets WHERE list_contains(arr, 'SMALL') GROUP BY 1),
  t AS (SELECT CAST(sum(n_docs) AS BIGINT) AS total_docs, count(*) AS n_sets FROM s)
  SELECT labels, n_docs, total_docs, n_sets, (SELECT count(DISTINCT l) FROM (SELECT unnest(string_split(labels, ';')) AS l FROM s)) AS n_labels,
    n_sets > 40 OR (SELECT count(DISTINCT l) FROM (SELECT unnest(string_split(labels, ';')) AS l FROM s)) > 20 AS refused FROM s, t""")
def label_set_counts(spark, sf):
    docs = label_sets(spark, sf)
    one = R.label_set_summary(docs, "labels", "SMALL")
    counts = R.label_set_counts(docs, "labels", "SMALL").select(F.concat_ws(";", "labels").alias("labels"), "n_docs")
    # the totals are one row of four scalars
    total = one.agg(F.first(F.struct("n_docs", "n_sets", "n_labels", "refused"))).scalar()
    return counts.withColumn("_t", total).select(
        "labels", "n_docs", F.col("_t.n_docs").alias("total_docs"), "_t.n_sets", "_t.n_labels", "_t.refused"
    )


@query("median_of_runs", """SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1""")
def median_of_runs(spark, sf):
    return R.median_of_runs(table(spark, sf, "events"), ["event_type"], "value")


@query("minmax_scale", """SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 6) AS scaled FROM events""")
def minmax_scale(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return R.minmax_scale(ev, "value", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("max_scale", """SELECT p_partkey, round(p_retailprice / (SELECT max(p_retailprice) FROM part), 6) AS scaled FROM part""")
def max_scale(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return R.max_scale(p, "p_retailprice", "scaled").select("p_partkey", F.round("scaled", 6).alias("scaled"))


COS_SQL = f"""{VECS_SQL}, u AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vx),
  cp AS (SELECT a.vec_id AS i, b.vec_id AS j, 1 - list_dot_product(a.v, b.v) / (a.n * b.n) AS dist, a.label AS la, b.label AS lb
    FROM u a JOIN u b ON a.vec_id < b.vec_id)"""


@query("abs_error_summary", f"""WITH {COS_SQL}, e AS (SELECT abs(dist - CASE WHEN la <> lb THEN 1 ELSE 0 END) AS x FROM cp)
  SELECT round(avg(x), 6) AS mean_abs, round(sum(x), 4) AS sum_abs, count(*) AS n_pairs, round(2 * sum(x), 4) AS matrix_sum,
    round(2 * sum(x) / ((SELECT count(*) FROM vx) * (SELECT count(*) FROM vx)), 6) AS matrix_mean FROM e""")
def abs_error_summary(spark, sf):
    got = abs_error_blocks(vectors(spark, sf), "vec_id", "cosine", "label")
    places = {"mean_abs": 6, "sum_abs": 4, "matrix_sum": 4, "matrix_mean": 6}
    return got.select("n_pairs", *[F.round(c, p).alias(c) for c, p in places.items()])


@query("append_rows", """SELECT 'c' AS source, c_name AS name, c_acctbal AS balance FROM customer
  UNION ALL SELECT 's', s_name, s_acctbal FROM supplier""")
def append_rows(spark, sf):
    return R.append_rows({
        "c": table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
        "s": table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
    })
