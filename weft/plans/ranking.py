"""Queries for ranks, top-k, samples, splits, greedy selection and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.text import words
from weft.operators import ranking as K
from weft.operators import relational as R
from weft.operators import wordsets as S
from weft.operators.cooccur import cooccur_group
from weft.operators.neighbours import fold_copies, jaccard_join, topk_neighbours
from weft.operators.order import positions
from weft.operators.paths import dedup_course_first, get_semester, path_string
from weft.operators.pairwise import nearest, pairwise
from weft.operators.vectors import idf_table, l2_normalise, term_counts, tfidf_vectors
from weft.plans.registry import query, table
from weft.plans.roles import (
    EXAMS_SQL, SONG_SQL, TOKENS_SQL, VECS_SQL, corpus, corpus_tokens, exams, publications, song_tags, vectors,
)
from weft.plans.relational import COS_SQL, NOVEL_SQL
from weft.session import cut

DEDUP_SQL = f"""{EXAMS_SQL}, cl AS (SELECT path_id, course, semester, grade, ects FROM (SELECT *,
    row_number() OVER (PARTITION BY path_id, course ORDER BY semester, event_id) AS rn FROM ex WHERE grade < 5) WHERE rn = 1)"""


@query("dedup_course_first", f"WITH {DEDUP_SQL} SELECT path_id, course, semester, CAST(grade AS INTEGER) AS grade, ects FROM cl")
def dedup(spark, sf):
    return dedup_course_first(exams(spark, sf)).select("path_id", "course", "semester", "grade", "ects")


@query("get_semester", f"WITH {DEDUP_SQL} SELECT path_id, course FROM cl WHERE semester = 1")
def semester(spark, sf):
    return get_semester(dedup_course_first(exams(spark, sf)), 1).select("path_id", "course")


@query("path_string", f"""WITH {DEDUP_SQL}, s AS (SELECT path_id, semester, string_agg(course, ',' ORDER BY course) AS c FROM cl GROUP BY ALL)
  SELECT path_id, string_agg(c, ' | ' ORDER BY semester) AS path FROM s GROUP BY path_id""")
def strings(spark, sf):
    return path_string(dedup_course_first(exams(spark, sf)))


TFIDF_SQL = f"""{TOKENS_SQL}, tf AS (SELECT doc_id, w, count(*) AS tf FROM tok GROUP BY ALL),
  dfs AS (SELECT w, count(*) AS df FROM tf GROUP BY w), nd AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
  idf AS (SELECT w, df, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM dfs, nd),
  raw AS (SELECT doc_id, w, tf, df, tf * idf AS x FROM tf JOIN idf USING (w)),
  tv AS (SELECT doc_id, w, tf, df, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM raw)"""


@query("topk_terms_per_dimension", f"""WITH {TFIDF_SQL}, cells AS (SELECT vec_id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)),
  ends AS (SELECT dim, 'least' AS side, arg_min(vec_id, struct_pack(x := x, v := vec_id)) AS doc FROM cells GROUP BY dim
    UNION ALL SELECT dim, 'greatest', arg_min(vec_id, struct_pack(x := -x, v := vec_id)) FROM cells GROUP BY dim),
  best AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY round(x, 9) DESC, w) AS rank FROM tv)
  SELECT CAST(dim AS INTEGER) AS dim, side, doc, CAST(rank AS INTEGER) AS rank, w FROM ends JOIN best ON doc = doc_id WHERE rank <= 5""")
def topk_terms_per_dimension(spark, sf):
    tv = tfidf_vectors(corpus_tokens(spark, sf).withColumnRenamed("w", "term"), "doc_id", "term").withColumn("w", F.round("w", 9))
    v = vectors(spark, sf).withColumnRenamed("vec_id", "doc_id")
    return K.topk_terms_per_dimension(v, "doc_id", "v", tv, "term", "w", 5).withColumnRenamed("term", "w")


@query("topk_idf_words", f"""WITH {TFIDF_SQL}, s AS (SELECT DISTINCT source AS "set", lang AS subset, w FROM tok JOIN documents USING (doc_id)),
  r AS (SELECT "set", subset, w, idf, row_number() OVER (PARTITION BY "set", subset ORDER BY idf DESC, w) AS rank FROM s JOIN idf USING (w))
  SELECT "set", subset, CAST(rank AS INTEGER) AS rank, w, round(idf, 6) AS idf FROM r WHERE rank <= 5""")
def topk_idf_words(spark, sf):
    counts = term_counts(corpus_tokens(spark, sf), "doc_id", "w")
    groups = corpus(spark, sf).select("doc_id", F.col("source").alias("set"), F.col("lang").alias("subset"))
    sets = counts.select("doc_id", "w").join(groups, "doc_id")
    top = K.topk_idf_words(sets, ["set", "subset"], "w", idf_table(counts, "doc_id", "w"))
    return top.withColumn("idf", F.round("idf", 6))


@query("topk_words_per_topic", f"""WITH {TOKENS_SQL}, c AS (SELECT source, w, count(*) AS n FROM tok JOIN documents USING (doc_id) GROUP BY ALL)
  SELECT source, w, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS rank FROM c) WHERE rank <= 10""")
def topk_words_per_topic(spark, sf):
    toks = corpus(spark, sf).select("source", F.explode(words(F.col("text"))).alias("w"))
    return K.topk_words_per_topic(toks.groupBy("source", "w").agg(F.count(F.lit(1)).alias("n")), "source", "w", "n", 10)


BENCH_SQL = r"""bt AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS w FROM benchmark),
  bf AS (SELECT item_id, w, count(*) AS tf FROM bt GROUP BY ALL),
  br AS (SELECT item_id, w, tf * idf AS x FROM bf JOIN idf USING (w)),
  bv AS (SELECT item_id, w, x / sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS x FROM br)"""


@query("topk_neighbours", f"""WITH {TFIDF_SQL}, {BENCH_SQL},
  s AS (SELECT item_id, doc_id, round(sum(bv.x * tv.x), 9) AS sim FROM bv JOIN tv USING (w) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) AS rank FROM s)
  SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id AS neighbour, round(sim, 6) AS sim FROM r WHERE rank <= 5""")
def nearest_documents(spark, sf):
    counts = term_counts(corpus_tokens(spark, sf), "doc_id", "w")
    idf = idf_table(counts, "doc_id", "w")
    docs = l2_normalise(counts.join(idf.hint("shuffle_hash"), "w").withColumn("x", F.col("tf") * F.col("idf")), "doc_id", "x")
    items = table(spark, sf, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("w"))
    weighed = term_counts(items, "item_id", "w").join(idf, "w").withColumn("x", F.col("tf") * F.col("idf"))
    top = topk_neighbours(l2_normalise(weighed, "item_id", "x"), "item_id", docs, "doc_id", "w", "x", 5)
    return top.withColumn("sim", F.round("sim", 6))


GROUP_SQL = f"""{SONG_SQL}, gc AS (SELECT song, tag, count(*) AS n FROM st GROUP BY ALL),
  gw AS (SELECT x.tag AS a, y.tag AS b, sum(CASE WHEN x.tag = y.tag THEN x.n * (x.n - 1) ELSE x.n * y.n END) AS w
    FROM gc x JOIN gc y USING (song) GROUP BY ALL HAVING sum(CASE WHEN x.tag = y.tag THEN x.n * (x.n - 1) ELSE x.n * y.n END) > 0),
  gm AS (SELECT a, b, w / (SELECT max(w) FROM gw) AS weight FROM gw)"""


@query("similar_terms", f"""WITH {GROUP_SQL}, n AS (SELECT a, sqrt(sum(weight * weight)) AS norm FROM gm GROUP BY a),
  t AS (SELECT min(a) AS t FROM gm), s AS (SELECT y.a AS term, sum(x.weight * y.weight) / (any_value(nx.norm) * any_value(ny.norm)) AS sim
    FROM gm x JOIN t ON x.a = t JOIN gm y ON x.b = y.b JOIN n nx ON nx.a = x.a JOIN n ny ON ny.a = y.a GROUP BY y.a),
  p AS (SELECT term, CASE WHEN sim >= 1.0 - 1e-12 THEN (SELECT min(sim) FROM s) ELSE sim END AS sim FROM s)
  SELECT term, round((sim - (SELECT min(sim) FROM p)) / ((SELECT max(sim) FROM p) - (SELECT min(sim) FROM p)), 6) AS rescaled FROM p""")
def similar_terms(spark, sf):
    m = cooccur_group(song_tags(spark, sf), "song", "tag")
    unit = l2_normalise(m, "a", "weight")
    first = m.agg(F.min("a")).scalar()
    one = unit.filter(F.col("a") == first).select("b", F.col("weight").alias("_w"))
    sims = unit.join(one, "b").groupBy(F.col("a").alias("term")).agg(F.sum(F.col("weight") * F.col("_w")).alias("sim"))
    return K.similar_terms(sims, "term", "sim").withColumn("rescaled", F.round("rescaled", 6))


@query("sort_labels", f"WITH {EXAMS_SQL} SELECT DISTINCT course FROM ex ORDER BY course")
def sort_labels(spark, sf):
    return K.sort_labels(exams(spark, sf), "course")


@query("ordered_matrix", f"""WITH {COS_SQL}, lf AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) AS pos FROM vx)
  SELECT least(x.pos, y.pos) AS row, greatest(x.pos, y.pos) AS col, round(dist, 6) AS dist
  FROM cp JOIN lf x ON x.vec_id = i JOIN lf y ON y.vec_id = j WHERE dist <= 0.6""")
def ordered_matrix(spark, sf):
    v = vectors(spark, sf)
    leaves = positions(v.select("vec_id", "label"), [], ["label", "vec_id"], "pos")
    got = K.ordered_matrix(pairwise(v, "vec_id", "cosine", 0.6), "i", "j", "dist", leaves, "vec_id", "pos")
    return got.withColumn("dist", F.round("dist", 6))


FORM_SQL = r"lower({w}) = {w} AND upper({w}) <> {w} AS {p}is_lower, regexp_matches({w}, '^\p{{Lu}}[^\p{{Lu}}]*$') AS {p}is_title, upper({w}) = {w} AND lower({w}) <> {w} AS {p}is_upper"


@query("token_context_features", rf"""WITH t AS (SELECT conv_id, turn, unnest(m) AS word, generate_subscripts(m, 1) - 1 AS pos, len(m) AS n FROM
    (SELECT conv_id, turn, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS m FROM conversations)),
  x AS (SELECT *, lag(word) OVER w AS pw, lead(word) OVER w AS nw FROM t WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos))
  SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, word, {FORM_SQL.format(w='word', p='')}, regexp_matches(word, '^[0-9]+$') AS is_digit,
    right(word, 2) AS suffix2, right(word, 3) AS suffix3, {FORM_SQL.format(w='pw', p='prev_')}, {FORM_SQL.format(w='nw', p='next_')},
    pos = 0 AS bos, pos = n - 1 AS eos FROM x""")
def token_context_features(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("text").isNotNull())
    toks = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return K.token_context_features(c, ["conv_id", "turn"], toks)


U_SQL = "(('0x' || substr(md5('{seed}|' || CAST({k} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("sample_three_sets", f"""WITH p AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS pos FROM part),
  d AS (SELECT i AS draw, CAST(floor({U_SQL.format(seed=1, k='i')} * (SELECT count(*) FROM part)) AS BIGINT) + 1 AS pick FROM range(0, 300) r(i))
  SELECT CAST(draw // 100 AS INTEGER) AS "set", draw, p_partkey, p_name FROM d JOIN p ON pos = pick""")
def sample_three_sets(spark, sf):
    return K.sample_three_sets(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"])


@query("random_split", f"""SELECT o_orderkey, CAST(CASE WHEN {U_SQL.format(seed=1, k='o_orderkey')} < 0.5 THEN 0 ELSE 1 END AS INTEGER) AS split,
  CAST({U_SQL.format(seed=1, k='o_orderkey')} < 0.1 AS INTEGER) AS test_0, CAST({U_SQL.format(seed=2, k='o_orderkey')} < 0.1 AS INTEGER) AS test_1 FROM orders""")
def random_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return K.shuffle_splits(K.random_split(o, "o_orderkey", [0.5, 0.5]), "o_orderkey")


ELIGIBLE_SQL = f"""{NOVEL_SQL}, pk AS (SELECT pub, count(DISTINCT keyword) AS nk,
    count(DISTINCT keyword) FILTER (WHERE keyword IN (SELECT keyword FROM novel)) AS nn FROM pubs WHERE year >= 1999 GROUP BY pub),
  el AS (SELECT pub, (pub * 48271 + 7) % 65521 AS ord FROM pk WHERE nk BETWEEN 3 AND 7 AND nn >= 1),
  rk AS (SELECT pub, row_number() OVER (ORDER BY ord, pub) AS r FROM el),
  au AS (SELECT r, pub, list(DISTINCT author) AS authors FROM rk JOIN pubs USING (pub) GROUP BY ALL)"""


def eligible(spark, sf):
    """Test publications with 3–7 keywords of which one is novel, with their walk order."""
    p = publications(spark, sf)
    test = p.filter("year >= 1999")
    novel = R.novel_keywords(test, p.filter("year < 1999"), "keyword").withColumn("novel", F.lit(1))
    keys = test.select("pub", "keyword").distinct().join(novel, "keyword", "left")
    per = keys.groupBy("pub").agg(F.count(F.lit(1)).alias("nk"), F.count("novel").alias("nn"))
    return per.filter(F.col("nk").between(3, 7) & (F.col("nn") >= 1)).select(
        "pub", ((F.col("pub") * 48271 + 7) % 65521).alias("ord")
    )


@query("author_disjoint_select", f"""WITH RECURSIVE {ELIGIBLE_SQL},
  walk AS (SELECT CAST(0 AS BIGINT) AS r, CAST(-1 AS BIGINT) AS pub, CAST([] AS BIGINT[]) AS used
    UNION ALL SELECT n.r, n.pub, list_concat(n.used, a.authors) FROM (
      SELECT min(a.r) AS r, arg_min(a.pub, a.r) AS pub, any_value(w.used) AS used FROM walk w JOIN au a ON a.r > w.r AND NOT list_has_any(a.authors, w.used)) n
      JOIN au a ON a.r = n.r)
  SELECT pub FROM walk WHERE pub >= 0""")
def author_disjoint_select(spark, sf):
    authors = publications(spark, sf).select("pub", "author")
    return K.author_disjoint_select(eligible(spark, sf), "pub", ["ord"], authors, "author").select("pub")


@query("keyword_budget_select", f"""WITH RECURSIVE {NOVEL_SQL},
  ks AS (SELECT pub, CAST((pub * 48271 + 7) % 65521 AS HUGEINT) * 10000000000000000000 + pub AS r, list(keyword) AS keys FROM pubs
    WHERE year >= 1999 AND keyword IN (SELECT keyword FROM novel) GROUP BY pub),
  walk AS (SELECT CAST(-1 AS HUGEINT) AS r, CAST([] AS VARCHAR[]) AS have
    UNION ALL SELECT n.r, list_distinct(list_concat(n.have, k.keys)) FROM (
      SELECT min(k.r) AS r, any_value(w.have) AS have FROM walk w JOIN ks k ON k.r > w.r AND len(w.have) + len(k.keys) <= 100
        AND NOT list_has_all(w.have, k.keys)) n JOIN ks k ON k.r = n.r),
  force AS (SELECT k.pub, k.r, k.keys, arg_max(w.have, w.r) AS have, max(w.r) AS wr FROM ks k JOIN walk w ON w.r < k.r GROUP BY ALL)
  SELECT pub FROM force WHERE len(have) + len(keys) <= 100 AND (r IN (SELECT r FROM walk) OR list_has_all(have, keys))""")
def keyword_budget_select(spark, sf):
    p = publications(spark, sf)
    test = p.filter("year >= 1999")
    novel = R.novel_keywords(test, p.filter("year < 1999"), "keyword")
    rows = K.keyword_lists(test.join(novel, "keyword", "left_semi"), "pub", "keyword")
    # both parts of the order in one number, wide enough that they can't meet
    order = ((F.col("pub") * 48271 + 7) % 65521).cast("decimal(5,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + F.col("pub")
    rows = cut(rows.withColumn("r", order.cast("decimal(38,0)")))
    return K.keyword_budget_select(rows, "pub", "r", "keys").select("pub")


# ---------------------------------------------------------------- set operations


@query("word_sets", f"""WITH {TOKENS_SQL}, x AS (SELECT DISTINCT source, w FROM tok JOIN documents USING (doc_id)),
  p AS (SELECT w, count(*) AS c, min(source) AS only_in FROM x GROUP BY w), n AS (SELECT count(DISTINCT source) AS n FROM x)
  SELECT 'inter' AS kind, CAST(NULL AS VARCHAR) AS source, w FROM p, n WHERE c = n UNION ALL SELECT 'only', only_in, w FROM p, n WHERE c = 1 AND n > 1""")
def word_sets(spark, sf):
    toks = corpus(spark, sf).select("source", F.explode(words(F.col("text"))).alias("w"))
    return S.word_sets(toks, "source", "w")


@query("group_comp", f"""WITH {TOKENS_SQL}, x AS (SELECT DISTINCT lang, source, w FROM tok JOIN documents USING (doc_id) WHERE lang IN ('en', 'de')),
  p AS (SELECT w, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'de') AS b FROM x GROUP BY w),
  n AS (SELECT count(DISTINCT source) FILTER (WHERE lang = 'en') AS na, count(DISTINCT source) FILTER (WHERE lang = 'de') AS nb FROM x)
  SELECT 'common_1' AS kind, w FROM p, n WHERE a = na UNION ALL SELECT 'common_2', w FROM p, n WHERE b = nb
  UNION ALL SELECT 'both', w FROM p WHERE a > 0 AND b > 0 UNION ALL SELECT 'only_1', w FROM p WHERE b = 0 UNION ALL SELECT 'only_2', w FROM p WHERE a = 0""")
def group_comp(spark, sf):
    toks = corpus(spark, sf).select("lang", "source", F.explode(words(F.col("text"))).alias("w"))
    return S.group_comp(toks, "lang", "source", "w", "en", "de")


JACC_SQL = r"""sets AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'))) AS s FROM documents),
  reps AS (SELECT min(doc_id) AS id, s, count(*) AS n FROM sets GROUP BY s),
  copies AS (SELECT id AS i, doc_id AS j, sets.s AS s FROM sets JOIN reps ON reps.s = sets.s WHERE doc_id <> id),
  jp AS (SELECT a.id AS i, b.id AS j, a.s AS sa, b.s AS sb, len(list_intersect(a.s, b.s)) AS c FROM reps a JOIN reps b ON a.id < b.id
    AND least(len(a.s), len(b.s)) >= 0.5 * greatest(len(a.s), len(b.s)))"""


def distinct_sets(spark, sf):
    """Distinct word sets (doc_id of the first copy, s, n_copies), and the other copies (i, j, s): j has the set of i."""
    sets = corpus(spark, sf).select("doc_id", F.array_sort(F.array_distinct(words(F.col("text")))).alias("s"))
    reps, members = fold_copies(cut(sets), "doc_id", ["s"])
    reps = cut(reps)
    copies = members.filter("doc_id <> rep").select(F.col("rep").alias("i"), F.col("doc_id").alias("j"))
    return reps, copies.join(reps.select(F.col("doc_id").alias("i"), "s"), "i")


@query("pair_word_overlap", f"""WITH {JACC_SQL} SELECT i, j, c AS n_common, CAST(len(sa) - c AS BIGINT) AS n_missing,
    array_to_string(list_sort(list_filter(sa, lambda x: NOT list_contains(sb, x))), ' ') AS missing
  FROM jp WHERE len(sa) > 0 AND 1 - c / (len(sa) + len(sb) - c) <= 0.5 UNION ALL SELECT i, j, len(s), 0, '' FROM copies""")
def pair_word_overlap(spark, sf):
    sets, copies = distinct_sets(spark, sf)
    pairs = jaccard_join(sets, "doc_id", "s", 0.5).select("i", "j")
    got = S.pair_word_overlap(pairs, "i", "j", sets, "doc_id", "s")
    size = lambda c: F.size(c).cast("bigint")
    found = got.select("i", "j", size("common").alias("n_common"), size("missing").alias("n_missing"), F.concat_ws(" ", "missing").alias("missing"))
    return found.unionByName(copies.select("i", "j", size("s").alias("n_common"), F.lit(0).cast("bigint").alias("n_missing"), F.lit("").alias("missing")))


@query("cluster_word_sets", f"""WITH {TOKENS_SQL}, x AS (SELECT DISTINCT length(w) % 6 AS cluster, lang, w FROM tok JOIN documents USING (doc_id)),
  p AS (SELECT cluster, w, max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS a, max(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS b
    FROM x WHERE lang IN ('en', 'fr') GROUP BY ALL),
  k AS (SELECT CAST(cluster AS INTEGER) AS cluster, count(*) FILTER (WHERE a = 1 AND b = 1) AS n_common, count(*) FILTER (WHERE b = 0) AS n_first,
    count(*) FILTER (WHERE a = 0) AS n_second FROM p GROUP BY cluster),
  sh AS (SELECT x.cluster AS c1, count(*) AS n_shared FROM (SELECT DISTINCT lang AS cluster, w FROM x) x
    JOIN (SELECT DISTINCT lang AS cluster, w FROM x) y ON x.w = y.w AND x.cluster < y.cluster GROUP BY 1)
  SELECT cluster, n_common, n_first, n_second, (SELECT CAST(sum(n_shared) AS BIGINT) FROM sh) AS n_shared FROM k""")
def cluster_word_sets(spark, sf):
    toks = corpus(spark, sf).select("lang", F.explode(words(F.col("text"))).alias("w")).withColumn("cluster", F.length("w") % 6)
    shared = S.cluster_shared_words(toks, "lang", "w").agg(F.count(F.lit(1))).scalar()
    return S.cluster_word_sets(toks, "cluster", "lang", "w", "en", "fr").withColumn("n_shared", shared)


@query("vocab_overlap", f"""WITH {TOKENS_SQL}, a AS (SELECT DISTINCT w FROM tok),
  b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS w FROM benchmark)
  SELECT count(*) FILTER (WHERE a.w IS NOT NULL AND b.w IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.w IS NULL) AS n_only_a,
    count(*) FILTER (WHERE a.w IS NULL) AS n_only_b, count(*) AS n_union FROM a FULL JOIN b ON a.w = b.w""")
def vocab_overlap(spark, sf):
    b = table(spark, sf, "benchmark").select(F.explode(words(F.col("text"))).alias("w"))
    return S.vocab_overlap(corpus_tokens(spark, sf), b, "w")


TOPICS_SQL = f"""{TOKENS_SQL}, c AS (SELECT lang AS m, source AS t, w, count(*) AS n FROM tok JOIN documents USING (doc_id) GROUP BY ALL),
  top AS (SELECT m, t, w FROM (SELECT *, row_number() OVER (PARTITION BY m, t ORDER BY n DESC, w) AS r FROM c) WHERE r <= 10),
  tk AS (SELECT m, t, list_sort(list(w)) AS s FROM top GROUP BY ALL)"""


def topic_words(spark, sf):
    toks = corpus(spark, sf).select(F.col("lang").alias("m"), F.col("source").alias("t"), F.explode(words(F.col("text"))).alias("w"))
    counts = toks.groupBy("m", "t", "w").agg(F.count(F.lit(1)).alias("n"))
    return K.top_k(counts, ["m", "t"], [F.desc("n"), F.asc("w")], 10).select("m", "t", "w")


@query("topic_set_jaccard", f"""WITH {TOPICS_SQL} SELECT a.m AS m1, b.m AS m2,
    round(avg(1 - len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))), 6) AS distance FROM tk a JOIN tk b ON a.m < b.m GROUP BY ALL""")
def topic_set_jaccard(spark, sf):
    return S.topic_set_jaccard(topic_words(spark, sf), "m", "t", "w").withColumn("distance", F.round("distance", 6))


def near_sql(alias, keep):
    return f"""{alias}p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_aggregate(list_transform(list_zip(a.v[{keep}], b.v[{keep}]), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum') AS d
      FROM vx a JOIN vx b ON a.vec_id <> b.vec_id),
    {alias} AS (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(sqrt(d), 9), j) AS r FROM {alias}p) WHERE r <= 10)"""


@query("neighbour_overlap_at_k", f"""WITH {VECS_SQL}, {near_sql('na', '1:32')}, {near_sql('nb', '33:64')},
  h AS (SELECT na.i AS i, count(*) AS n FROM na JOIN nb ON na.i = nb.i AND na.j = nb.j GROUP BY 1)
  SELECT vec_id AS item, round(coalesce(n, 0) / 10, 6) AS overlap FROM vx LEFT JOIN h ON i = vec_id""")
def neighbour_overlap_at_k(spark, sf):
    v = vectors(spark, sf)
    a = nearest(v.select("vec_id", F.slice("v", 1, 32).alias("v")), "vec_id", "euclidean", 10)
    b = nearest(v.select("vec_id", F.slice("v", 33, 32).alias("v")), "vec_id", "euclidean", 10)
    return S.neighbour_overlap_at_k(a, b, "item", "neighbour", 10).withColumn("overlap", F.round("overlap", 6))
