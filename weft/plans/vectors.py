"""Queries for term weights, distances, neighbours and paths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from weft.functions.text import folded_space_words
from weft.operators import neighbours as N
from weft.operators import pairwise as P
from weft.operators import paths as H
from weft.operators import vectors as V
from weft.operators.relational import neighbour_stats_join as join_stats
from weft.plans.ranking import DEDUP_SQL, JACC_SQL, TFIDF_SQL, distinct_sets
from weft.plans.registry import query, table
from weft.plans.relational import COS_SQL
from weft.plans.roles import EXAMS_SQL, TOKENS_SQL, VECS_SQL, WORD_VECTOR_SQL, corpus, corpus_tokens, exams, vectors, word_vector_id
from weft.session import cut


def micro(v):
    """A vector as text, in millionths."""
    return F.concat_ws(",", F.transform(v, lambda x: F.round(x * 1000000).cast("bigint").cast("string")))


def rounded(df, col, places=6):
    return df.withColumn(col, F.round(col, places))


# ---------------------------------------------------------------- term weights


@query("count_vectors", f"""WITH {TOKENS_SQL}, tf AS (SELECT doc_id, w AS term, count(*) AS tf FROM tok GROUP BY ALL)
  SELECT doc_id, term, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS w FROM tf""")
def count_vectors(spark, sf):
    toks = corpus_tokens(spark, sf).withColumnRenamed("w", "term")
    return rounded(V.count_vectors(toks, "doc_id", "term"), "w")


@query("tfidf_vectors", """WITH tok AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  raw AS (SELECT doc_id, term, tf, df, tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM tf))::DOUBLE / (1 + df)) + 1) AS x FROM tf JOIN dfs USING (term))
  SELECT doc_id, term, tf, df, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS w FROM raw""")
def tfidf_vectors(spark, sf):
    toks = V.tokenize_custom(corpus(spark, sf), "doc_id", "text", folded_space_words)
    return rounded(V.tfidf_vectors(toks, "doc_id", "term"), "w")


@query("tokenize_custom", f"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS term FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  n AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
  raw AS (SELECT doc_id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS x FROM tf JOIN dfs USING (term), n WHERE df >= 2 AND df <= 0.5 * n)
  SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS w FROM raw""")
def tokenize_custom(spark, sf):
    toks = V.tokenize_custom(corpus(spark, sf), "doc_id", "text", lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}]+"), F.lit(0)))
    return rounded(V.tfidf_vectors(toks, "doc_id", "term", min_df=2, max_df=0.5), "w").select("doc_id", "term", "w")


@query("lookup_word_vectors", f"""WITH {TOKENS_SQL}, {VECS_SQL} SELECT doc_id, w, count(*) AS n, array_to_string(list_transform(any_value(v), lambda x: CAST(round(x * 1000000) AS BIGINT)), ',') AS v
  FROM tok JOIN vx ON vec_id = {WORD_VECTOR_SQL} GROUP BY ALL""")
def lookup_word_vectors(spark, sf):
    t = V.term_counts(corpus_tokens(spark, sf), "doc_id", "w").withColumnRenamed("tf", "n")
    t = t.withColumn("vec_id", word_vector_id(spark, sf))
    got = V.lookup_word_vectors(t, "vec_id", vectors(spark, sf), "v")
    return got.select("doc_id", "w", "n", micro("v").alias("v"))


def word_vector_tokens(spark, sf):
    """Tokens named by the stored vector of their word."""
    return corpus_tokens(spark, sf).select("doc_id", word_vector_id(spark, sf).alias("vec_id"))


WV_SQL = f"""{TOKENS_SQL}, {VECS_SQL}, wt AS (SELECT doc_id, {WORD_VECTOR_SQL} AS vec_id FROM tok),
  wc AS (SELECT doc_id, vec_id, count(*) AS c FROM wt GROUP BY ALL), dims AS (SELECT CAST(unnest(range(1, 65)) AS INTEGER) AS d)"""


@query("doc_vector_mean", f"""WITH {WV_SQL} SELECT doc_id, CAST(d - 1 AS INTEGER) AS dim, round(sum(c * v[d]) / sum(c), 6) AS x
  FROM wc JOIN vx USING (vec_id), dims GROUP BY doc_id, d""")
def doc_vector_mean(spark, sf):
    # one row per distinct word of a document, with its count as weight
    t = V.term_counts(word_vector_tokens(spark, sf), "doc_id", "vec_id")
    known = vectors(spark, sf)
    found = V.lookup_word_vectors(t, "vec_id", known, "v", "doc_id", F.col("tf").cast("double"))
    got = V.mean_by(found, ["doc_id"], "v", F.col("weight"), dim=V.width(known, "v"))
    return rounded(got.select("doc_id", F.posexplode("mean").alias("dim", "x")), "x")


@query("doc_vector_weighted", f"""WITH {WV_SQL}, dfs AS (SELECT vec_id, count(*) AS df FROM wc GROUP BY 1),
  idf AS (SELECT vec_id, ln((1 + (SELECT count(DISTINCT doc_id) FROM wc))::DOUBLE / (1 + df)) + 1 AS idf FROM dfs),
  m AS (SELECT doc_id, d, sum(c * c * idf * v[d]) / sum(c * c * idf) AS x FROM wc JOIN idf USING (vec_id) JOIN vx USING (vec_id), dims GROUP BY doc_id, d)
  SELECT doc_id, CAST(d - 1 AS INTEGER) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM m""")
def doc_vector_weighted(spark, sf):
    toks = word_vector_tokens(spark, sf)
    idf = V.idf_table(V.term_counts(toks, "doc_id", "vec_id"), "doc_id", "vec_id")
    got = V.doc_vector_weighted(toks, "doc_id", "vec_id", vectors(spark, sf), "v", idf)
    return rounded(got.select("doc_id", F.posexplode("vec").alias("dim", "x")), "x")


# ---------------------------------------------------------------- distances


@query("all_pairs", "SELECT a.s_suppkey AS i, b.s_suppkey AS j, a.s_nationkey AS s_nationkey_i, b.s_nationkey AS s_nationkey_j FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def all_pairs(spark, sf):
    return P.all_pairs(table(spark, sf, "supplier"), "s_suppkey", ["s_nationkey"])


@query("dist_cosine", f"""WITH {TFIDF_SQL}, sg AS (SELECT doc_id, string_agg(w || ':' || tf, ',' ORDER BY w) AS s FROM tv GROUP BY 1),
  reps AS (SELECT min(doc_id) AS id, count(*) AS n FROM sg GROUP BY s),
  p AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(a.x * b.x) AS sim FROM tv a JOIN tv b ON a.w = b.w AND a.doc_id < b.doc_id
    WHERE a.doc_id IN (SELECT id FROM reps) AND b.doc_id IN (SELECT id FROM reps) GROUP BY ALL)
  SELECT x.id AS i, y.id AS j, round(1 - coalesce(sim, 0), 6) AS dist, x.n AS n_i, y.n AS n_j FROM reps x JOIN reps y ON x.id < y.id LEFT JOIN p ON i = x.id AND j = y.id
  UNION ALL SELECT id, doc_id, 0, n, n FROM sg JOIN (SELECT min(doc_id) AS id, count(*) AS n, s FROM sg GROUP BY s) USING (s) WHERE doc_id <> id""")
def dist_cosine(spark, sf):
    """Every two distinct documents at their cosine distance, with the number of copies of each; then every further
    copy at distance 0 of its first one."""
    tv = cut(V.tfidf_vectors(corpus_tokens(spark, sf).withColumnRenamed("w", "term"), "doc_id", "term"))
    reps, members = N.fold_weighted(tv, "doc_id", "term", "tf")
    reps = cut(reps)
    copies = members.filter("doc_id <> rep").join(reps.toDF("rep", "n"), "rep")
    pairs = N.cosine_join(tv.join(reps.toDF("doc_id", "n"), "doc_id"), "doc_id", "term", "w", "df", held=["n"])
    found = pairs.select("i", "j", F.round(1 - F.col("sim"), 6).alias("dist"), "n_i", "n_j")
    return found.unionByName(copies.select(F.col("rep").alias("i"), F.col("doc_id").alias("j"), F.lit(0.0).alias("dist"), F.col("n").alias("n_i"), F.col("n").alias("n_j")))


@query("dist_emd", f"""WITH {VECS_SQL}, s AS (SELECT vec_id, list_sort(v) AS s FROM vx),
  p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_avg(list_transform(list_zip(a.s, b.s), lambda z: abs(z[1] - z[2]))) AS dist FROM s a JOIN s b ON a.vec_id < b.vec_id)
  SELECT i, j, round(dist, 6) AS dist FROM p WHERE dist <= 0.0105""")
def dist_emd(spark, sf):
    # the means of two vectors differ by at most their distance, so only near ranges meet
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return rounded(P.radius_join(vectors(spark, sf), "vec_id", "emd", 0.0105, mean, 0.0105), "dist")


@query("dist_energy", f"""WITH {VECS_SQL}, c AS (SELECT vec_id, unnest(v) AS x FROM vx),
  pr AS (SELECT a.vec_id AS i, b.vec_id AS j FROM vx a JOIN vx b ON a.vec_id < b.vec_id),
  m AS (SELECT i, j, x, 1.0 / 64 AS s FROM pr JOIN c ON vec_id = i UNION ALL SELECT i, j, x, -1.0 / 64 FROM pr JOIN c ON vec_id = j),
  g AS (SELECT i, j, x, sum(s::DOUBLE) OVER w AS f, lead(x) OVER w - x AS gap FROM m WINDOW w AS (PARTITION BY i, j ORDER BY x, s ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT i, j, sqrt(2 * sum(f * f * gap)) AS dist FROM g GROUP BY ALL)
  SELECT i, j, round(dist, 6) AS dist FROM d WHERE dist <= 0.025""")
def dist_energy(spark, sf):
    # sqrt(2 ∫(F − G)²) is at least sqrt(2 / L) times the difference of the means for values in a range
    # of length L; the components of unit vectors lie in [−1, 1]
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return rounded(P.radius_join(vectors(spark, sf), "vec_id", "energy", 0.025, mean, 0.025), "dist")


@query("dist_jaccard_set", f"""WITH {JACC_SQL} SELECT i, j, round(1 - c / (len(sa) + len(sb) - c), 6) AS dist FROM jp WHERE len(sa) > 0 AND 1 - c / (len(sa) + len(sb) - c) <= 0.5
  UNION ALL SELECT i, j, 0 FROM copies""")
def dist_jaccard_set(spark, sf):
    """Distinct sets at a distance of at most 0.5, and every further copy at distance 0 of its first one."""
    sets, copies = distinct_sets(spark, sf)
    return rounded(N.jaccard_join(sets, "doc_id", "s", 0.5), "dist").unionByName(copies.select("i", "j", F.lit(0.0).alias("dist")))


@query("dist_jaccard_bits", f"""WITH {VECS_SQL}, b AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x > 0.1 THEN 1 ELSE 0 END) AS b FROM vx),
  p AS (SELECT x.vec_id AS i, y.vec_id AS j, list_sum(list_transform(list_zip(x.b, y.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS ne,
    list_sum(list_transform(list_zip(x.b, y.b), lambda z: CASE WHEN z[1] + z[2] > 0 THEN 1 ELSE 0 END)) AS nz FROM b x JOIN b y ON x.vec_id < y.vec_id)
  SELECT i, j, round(CASE WHEN nz > 0 THEN ne / nz ELSE 0 END, 6) AS dist FROM p WHERE CASE WHEN nz > 0 THEN ne / nz ELSE 0 END <= 0.66""")
def dist_jaccard_bits(spark, sf):
    bits = vectors(spark, sf).select("vec_id", F.transform("v", lambda x: (x > 0.1).cast("double")).alias("v"))
    return rounded(P.radius_join(bits, "vec_id", "jaccard_bits", 0.66), "dist")


@query("distance_options", f"""WITH {COS_SQL} SELECT i, j, round(1 - dist / (SELECT max(dist) FROM cp), 6) AS sim FROM cp WHERE dist <= 0.68""")
def distance_options(spark, sf):
    got = P.similarity_matrix(vectors(spark, sf), "vec_id", "cosine", as_distance=False, scaled=True, max_dist=0.68)
    return rounded(got, "sim")


def manhattan(a, b):
    return np.abs(a - b).sum(axis=-1)


@query("pairwise_custom", f"""WITH {VECS_SQL}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) AS dist
    FROM vx a JOIN vx b ON a.vec_id < b.vec_id) SELECT i, j, round(dist, 6) AS dist FROM p WHERE dist <= 7.3""")
def pairwise_custom(spark, sf):
    return rounded(P.pairwise_custom(vectors(spark, sf), "vec_id", "v", manhattan, 7.3, arrays=True), "dist")


@query("radius_join", f"""WITH {VECS_SQL}, p AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist
    FROM vx a JOIN vx b ON a.vec_id < b.vec_id) SELECT i, j, round(dist, 6) AS dist FROM p WHERE dist <= 1.165""")
def radius_join(spark, sf):
    # one coordinate differs by at most the Euclidean distance
    return rounded(P.radius_join(vectors(spark, sf), "vec_id", "euclidean", 1.165, F.get("v", F.lit(0)), 1.165), "dist")


MODELS_SQL = f"""{VECS_SQL}, md AS (SELECT 'whole' AS model, vec_id, v FROM vx UNION ALL SELECT 'half', vec_id, v[1:32] FROM vx),
  mu AS (SELECT model, vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM md),
  cp AS (SELECT a.model AS model, a.vec_id AS i, b.vec_id AS j, 1 - list_dot_product(a.v, b.v) / (a.n * b.n) AS dist FROM mu a JOIN mu b ON a.model = b.model AND a.vec_id < b.vec_id),
  m AS (SELECT model, max(dist) AS top FROM cp GROUP BY 1), b AS (SELECT model, i, dist FROM cp UNION ALL SELECT model, j, dist FROM cp)"""
SHARE_SQL = "SELECT model, item, round((value - min(value) OVER g) / (sum(value) OVER g - min(value) OVER g * count(*) OVER g), 6) AS value FROM a WINDOW g AS (PARTITION BY model)"


def two_models(spark, sf):
    """The stored vectors, and their first halves as a second embedding of the same items."""
    v = vectors(spark, sf)
    return {"whole": v, "half": v.withColumn("v", F.slice("v", 1, 32))}


@query("embedding_mean_distance", f"""WITH {MODELS_SQL}, a AS (SELECT model, i AS item, sum(dist) / any_value(top) / (count(*) + 1) AS value FROM b JOIN m USING (model) GROUP BY ALL)
  {SHARE_SQL}""")
def embedding_mean_distance(spark, sf):
    got = P.embedding_mean_distance(two_models(spark, sf), "vec_id", "cosine", probabilistic=True)
    return rounded(got, "value")


@query("embedding_radius_count", f"""WITH {MODELS_SQL}, a AS (SELECT model, i AS item, CAST(count(*) FILTER (WHERE dist <= 0.6 * top) AS DOUBLE) AS value FROM b JOIN m USING (model) GROUP BY ALL)
  {SHARE_SQL}""")
def embedding_radius_count(spark, sf):
    got = P.embedding_radius_count(two_models(spark, sf), "vec_id", "cosine", 0.6)
    return rounded(got, "value")


@query("threshold_graph", f"""WITH {COS_SQL}, e AS (SELECT i, j, dist FROM cp WHERE dist <= 0.66 AND dist <> 0),
  d AS (SELECT n, count(*) AS degree FROM (SELECT i AS n FROM e UNION ALL SELECT j FROM e) GROUP BY 1)
  SELECT i AS src, j AS dst, round(dist, 6) AS weight, a.degree AS deg_src, b.degree AS deg_dst FROM e JOIN d a ON a.n = i JOIN d b ON b.n = j""")
def threshold_graph(spark, sf):
    edges = P.threshold_graph_dist(P.pairwise(vectors(spark, sf), "vec_id", "cosine", 0.66), 0.66)
    deg = P.degrees(edges)
    return rounded(
        edges.join(deg.toDF("src", "deg_src"), "src").join(deg.toDF("dst", "deg_dst"), "dst"), "weight"
    ).select("src", "dst", "weight", "deg_src", "deg_dst")


@query("block_truth_matrix", f"""WITH {COS_SQL} SELECT i, j, CAST(la <> lb AS INTEGER) AS truth FROM cp WHERE dist <= 0.68""")
def block_truth_matrix(spark, sf):
    v = vectors(spark, sf)
    return P.block_truth(P.pairwise(v, "vec_id", "cosine", 0.68), v, "vec_id", "label")


NB_SQL = f"""{COS_SQL}, nb AS (SELECT i AS item, j AS neighbour, 1 - dist AS sim FROM cp WHERE 1 - dist >= 0.32
    UNION ALL SELECT j, i, 1 - dist FROM cp WHERE 1 - dist >= 0.32)"""


@query("neighbours_above", f"WITH {NB_SQL} SELECT item, neighbour, round(sim, 6) AS sim FROM nb")
def neighbours_above(spark, sf):
    return rounded(N.neighbours_above(vectors(spark, sf), "vec_id", "v", 0.32), "sim")


@query("neighbour_counts", f"""WITH {NB_SQL}, {TOKENS_SQL}, oc AS (SELECT {WORD_VECTOR_SQL} AS vec_id, count(*) AS n FROM tok GROUP BY 1),
  g AS (SELECT neighbour, CAST(sum(n) AS BIGINT) AS g FROM nb JOIN oc ON item = vec_id GROUP BY 1),
  s AS (SELECT item, count(*) AS s, string_agg(CAST(neighbour AS VARCHAR), ',' ORDER BY neighbour) AS l FROM nb GROUP BY 1)
  SELECT oc.vec_id AS vec_id, n AS count, n + coalesce(g, 0) AS is_neighbour_count, coalesce(s, 0) AS neighbour_count, CAST(0 AS BIGINT) AS part, coalesce(l, '') AS neighbours
  FROM oc LEFT JOIN g ON g.neighbour = oc.vec_id LEFT JOIN s ON s.item = oc.vec_id""")
def neighbour_counts(spark, sf):
    nb = cut(N.neighbours_above(vectors(spark, sf), "vec_id", "v", 0.32))
    counts = N.neighbour_counts(word_vector_tokens(spark, sf), "vec_id", nb)
    # a list of more than 10,000 neighbours goes on in a second row
    lists = N.neighbour_lists(nb).withColumnRenamed("item", "vec_id")
    return counts.join(lists, "vec_id", "left").na.fill({"neighbours": "", "part": 0})


@query("neighbour_stats_join", f"""WITH {COS_SQL}, {TOKENS_SQL}, oc AS (SELECT {WORD_VECTOR_SQL} AS vec_id, count(*) AS n FROM tok GROUP BY 1),
  b AS (SELECT CASE WHEN i = 0 THEN j ELSE i END AS vec_id, round(1 - dist, 9) AS sim FROM cp WHERE i = 0 OR j = 0),
  t AS (SELECT * FROM b ORDER BY sim DESC, vec_id LIMIT 25) SELECT vec_id, round(sim, 6) AS sim, n FROM t JOIN oc USING (vec_id)""")
def neighbour_stats_join(spark, sf):
    v = vectors(spark, sf)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = v.select("vec_id", F.transform("v", lambda x: x / norm).alias("u"))
    # the queried term is one row: its vector is a scalar
    q = unit.filter("vec_id = 0").agg(F.first("u")).scalar()
    dot = F.aggregate(F.zip_with("u", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    sims = unit.filter("vec_id <> 0").withColumn("q", q).select("vec_id", F.round(dot, 9).alias("sim"))
    counts = word_vector_tokens(spark, sf).groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(join_stats(sims, counts, "vec_id", 25, "sim"), "sim")


# ---------------------------------------------------------------- paths


@query("path_totals", f"""WITH {EXAMS_SQL} SELECT path_id, round(sum(ects), 4) AS ects, round(coalesce(sum(ects) FILTER (WHERE grade < 5), 0), 4) AS ects_passed,
  round(coalesce(sum(ects) FILTER (WHERE grade >= 5), 0), 4) AS ects_failed FROM ex GROUP BY 1""")
def path_totals(spark, sf):
    got = H.path_totals(exams(spark, sf))
    return got.select("path_id", *[F.round(c, 4).alias(c) for c in ("ects", "ects_passed", "ects_failed")])


@query("path_grades", f"""WITH {EXAMS_SQL} SELECT path_id, round(avg(grade), 6) AS mean_grade, list_sort(list(grade))[count(*) // 2 + 1] AS median_grade FROM ex GROUP BY 1""")
def path_grades(spark, sf):
    return rounded(H.path_grades(exams(spark, sf)), "mean_grade")


@query("path_semester_load", f"""WITH {EXAMS_SQL}, s AS (SELECT path_id, semester, sum(ects) AS e FROM ex GROUP BY ALL)
  SELECT path_id, round(max(e), 4) AS peak_ects, round(avg(e), 4) AS mean_ects FROM s GROUP BY 1""")
def path_semester_load(spark, sf):
    return rounded(rounded(H.path_semester_load(exams(spark, sf)), "peak_ects", 4), "mean_ects", 4)


@query("path_span", f"""WITH {DEDUP_SQL}, p AS (SELECT DISTINCT c_custkey AS path_id FROM customer UNION SELECT DISTINCT path_id FROM ex)
  SELECT p.path_id AS path_id, min(semester) AS first_semester, max(semester) AS last_semester, CAST(coalesce(max(semester), -1) + 1 AS INTEGER) AS n_semesters,
    max(semester) IS NULL AS is_empty FROM p LEFT JOIN cl ON cl.path_id = p.path_id GROUP BY p.path_id""")
def path_span(spark, sf):
    ex = exams(spark, sf)
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("path_id")).unionByName(ex.select("path_id"))
    return H.path_span(H.dedup_course_first(ex), people)


PATH_SQL = f"""{DEDUP_SQL}, pi AS (SELECT path_id, list(course ORDER BY course) AS courses, max(semester) + 1 AS n,
    map_from_entries(list((course, semester))) AS m FROM cl GROUP BY path_id)"""


def path_items(spark, sf):
    ex = exams(spark, sf)
    return H.path_items(H.dedup_course_first(ex), ex.select("path_id"))


LOOKUP_SQL = """un AS (SELECT a.path_id AS a, b.path_id AS b, a.m AS ma, b.m AS mb, a.n AS na, b.n AS nb,
    list_sort(list_distinct(list_concat(a.courses, b.courses))) AS u FROM pi a JOIN pi b ON {on}),
  lk AS (SELECT a, b, u, list_transform(u, lambda c: coalesce(ma[c], na)) AS pa, list_transform(u, lambda c: coalesce(mb[c], nb)) AS pb,
    list_transform(u, lambda c: ma[c] IS NOT NULL) AS ha, list_transform(u, lambda c: mb[c] IS NOT NULL) AS hb FROM un)"""


@query("course_lookup", f"""WITH {PATH_SQL}, {LOOKUP_SQL.format(on='b.path_id = a.path_id + 1')}
  SELECT a, b, array_to_string(u, ',') AS courses, array_to_string(pa, ',') AS pos_a, array_to_string(pb, ',') AS pos_b FROM lk""")
def course_lookup(spark, sf):
    items = path_items(spark, sf)
    pairs = items.select(F.col("path_id").alias("a"), (F.col("path_id") + 1).alias("b")).join(items.select(F.col("path_id").alias("b")), "b", "left_semi")
    got = H.course_lookup(pairs, "a", "b", items)
    return got.select("a", "b", F.concat_ws(",", "course_names").alias("courses"), *[
        F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("pos_a", "pos_b")
    ])


# each pair's courses as rows, then course pairs by a join on the pair
ORDER_SQL = f"""{PATH_SQL}, {LOOKUP_SQL.format(on='a.path_id < b.path_id')},
  cr AS (SELECT a, b, unnest(pa) AS pa, unnest(pb) AS pb, unnest(ha) AS ha, unnest(hb) AS hb, generate_subscripts(u, 1) AS k FROM lk),
  cp AS (SELECT x.a AS a, x.b AS b, sign(x.pa - y.pa) AS sa, sign(x.pb - y.pb) AS sb, x.ha AND y.ha AS ha, x.hb AND y.hb AS hb
    FROM cr x JOIN cr y ON x.a = y.a AND x.b = y.b AND x.k < y.k)"""


@query("path_dist_order", f"""WITH {ORDER_SQL} SELECT a AS i, b AS j, CAST(count(*) FILTER (WHERE sa <> sb) AS DOUBLE) AS dist FROM cp GROUP BY ALL""")
def path_dist_order(spark, sf):
    """Every two paths at their distance."""
    return H.path_distance(path_items(spark, sf), "order")


@query("path_dist_order_improved", f"""WITH {ORDER_SQL}, d AS (SELECT a, b, avg(CASE WHEN CASE WHEN ha THEN sa ELSE 0 END <> CASE WHEN hb THEN sb ELSE 1 END THEN 1 ELSE 0 END) AS dist FROM cp GROUP BY ALL)
  SELECT a AS i, b AS j, round(dist, 6) AS dist FROM d WHERE dist <= 0.68""")
def path_dist_order_improved(spark, sf):
    return rounded(H.path_distance(path_items(spark, sf), "order_share", max_dist=0.68), "dist")


@query("path_dist_emd", f"""WITH {PATH_SQL}, {LOOKUP_SQL.format(on='a.path_id < b.path_id')},
  d AS (SELECT a, b, list_avg(list_transform(list_zip(list_sort(pa), list_sort(pb)), lambda z: abs(z[1] - z[2]))) AS dist FROM lk)
  SELECT a AS i, b AS j, round(dist, 6) AS dist FROM d WHERE dist <= 0.151""")
def path_dist_emd(spark, sf):
    return rounded(H.path_distance(path_items(spark, sf), "path_emd", max_dist=0.151), "dist")


ENERGY_SQL = f"""{PATH_SQL}, {LOOKUP_SQL.format(on='a.path_id < b.path_id')},
  d AS (SELECT a, b, sqrt(2 * list_sum(list_transform(range(0, 6), lambda t: power((len(list_filter(pa, lambda p: p <= t)) - len(list_filter(pb, lambda p: p <= t))) / len(u), 2)))) AS dist FROM lk)"""


@query("path_dist_energy", f"WITH {ENERGY_SQL} SELECT a AS i, b AS j, round(dist, 6) AS dist FROM d WHERE dist <= 0.1225")
def path_dist_energy(spark, sf):
    return rounded(H.path_distance(path_items(spark, sf), "path_energy", max_dist=0.1225), "dist")


@query("path_dist_matrix", f"""WITH {ENERGY_SQL} SELECT a AS i, b AS j, round(dist, 6) AS dist FROM d UNION ALL SELECT b, a, round(dist, 6) FROM d""")
def path_dist_matrix(spark, sf):
    return rounded(P.mirrored(H.path_distance(path_items(spark, sf), "path_energy")), "dist")
