from collections import Counter, defaultdict

from pyspark.sql import functions as F

from weft.llm import dedup


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return Counter((d, max([i for i in g if i is not None], default=None), len(g)) for g in groups.values() for d in g)


def plain(df):
    return Counter((r.doc_id, r.keep_id, r.group_size) for r in df.collect())


def test_edge_rows(edge):
    out = dedup.exact_groups(edge)
    assert plain(out) == expected([(r.doc_id, r.text) for r in edge.collect()])
    kept = Counter(r.text_sha256 for r in out.where("kept").collect())
    assert set(kept.values()) == {1} and len(kept) == out.select("text_sha256").distinct().count()


def test_no_rows(no_rows):
    assert dedup.exact_groups(no_rows).count() == 0 and dedup.drop_copies(no_rows).count() == 0


def test_colliding_keys_and_splits(docs):
    """A key of 16 values chains many texts; a capacity of 3 splits the directory."""
    weak = dedup.exact_groups(docs, key=F.pmod(F.xxhash64("text"), F.lit(16)), capacity=3)
    assert plain(weak) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    leaves = dedup.directory(keys, 50).collect()
    assert sum(r.n for r in leaves) == 1000 and max(r.n for r in leaves) <= 50
    assert sum(2.0 ** -r.depth for r in leaves) <= 1.0
    one = spark.range(1000).select(F.lit(7).cast("long").alias("key"))
    assert [(r.depth, r.n) for r in dedup.directory(one, 50).collect()] == [(0, 1)]  # copies of a key force no split


def test_drop_copies_keeps_all_columns(edge):
    out = dedup.drop_copies(edge)
    assert out.columns == edge.columns
    rows = out.collect()
    assert Counter(r.text or "" for r in rows) == Counter({r.text or "" for r in edge.collect()})
    assert {r.doc_id for r in rows if (r.text or "") == ""} == {5}
    assert [r.doc_id for r in rows if r.text == "a small text with enough words to be a text of its own kind"] == [2]


def test_rows_are_found_through_the_directory(docs):
    """Without one of its leaves, the index answers for no row of that bucket, and for all others as before."""
    rows = dedup.keyed(docs, "doc_id", "text")
    key = dedup.key64(F.col("text"))
    entries, leaves = dedup.index(rows, key, capacity=40)
    probes = dedup.keys(rows, key)
    whole = dedup.probed(probes, entries, leaves).collect()
    assert len(whole) == docs.count()
    lost = leaves.orderBy("depth", "prefix").first()
    rest = leaves.where(f"NOT (depth = {lost.depth} AND prefix = {lost.prefix})")
    inside = dedup.in_buckets(probes, leaves).where(f"depth = {lost.depth} AND prefix = {lost.prefix}").count()
    assert rest.count() > 0 and inside > 0 and dedup.probed(probes, entries, rest).count() == len(whole) - inside


def test_index_is_in_order_of_unsigned_prefixes(docs):
    entries, leaves = dedup.index(dedup.keyed(docs, "doc_id", "text"), dedup.key64(F.col("text")), capacity=40)
    files = entries.withColumn("file", F.input_file_name()).groupBy("file").agg(F.min(F.expr("shiftleft(prefix, 63 - depth)")).alias("low"), F.max(F.expr("shiftleft(prefix, 63 - depth)")).alias("high")).orderBy("low").collect()
    assert all(a.high <= b.low for a, b in zip(files, files[1:])) and leaves.count() > 1
    assert entries.where((F.col("depth") > 0) & (F.expr("shiftrightunsigned(key, 64 - depth)") != F.col("prefix"))).count() == 0
