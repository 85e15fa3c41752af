"""The thin queries of the corpus operators, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dedup, extract, language, packing, quality, secrets, simhash, tokenstore, toxicity, trie, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op2_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html)::BIGINT AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM k)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {warc.REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {warc.REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to
FROM f
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


@query("op3_html_extract")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract.main_text(pages, keep=["url"]).select(F.col("doc_id").alias("page_id"), "url", "text", "n_chars")


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op6_bpe_codec")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_and_decoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op9_quality_rules", f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
tokens AS (SELECT doc_id, unnest(words) AS a, unnest(range(len(words))) AS i FROM w),
grams AS (SELECT doc_id, i, a, lead(a) OVER d AS b, lead(a, 2) OVER d AS c FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams WHERE c IS NOT NULL),
covered AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM windows WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i) AS n FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, w.source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
      FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS mean, greatest(sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) ** 2, 0) AS spread FROM h),
k AS (SELECT mean, CASE WHEN spread > 1e-12 THEN greatest(1.0, mean * (1 - mean) / spread - 1) ELSE 1e12 END AS strength FROM p),
r AS (SELECT source, mean, n + strength AS total, (f + strength * mean) / (n + strength) AS rate FROM h, k),
l AS (SELECT source, mean, rate - {quality.DEVIATIONS} * sqrt(rate * (1 - rate) / (total + 1)) AS low FROM r),
v AS (SELECT source, low * (1 - mean) > {quality.ODDS} * mean * (1 - low) AS rejected FROM l)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (rejected AND (100 * n_repeat_words > {quality.MINOR['n_repeat_words']} * n_words
           OR 100 * n_symbols > {quality.MINOR['n_symbols']} * word_chars
           OR 100 * n_dup_lines > {quality.MINOR['n_dup_lines']} * n_words)) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select("doc_id", *quality.FIELDS, "base_failed", "kept")


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


@query("op12_prefix_trie", f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
         lambda a, x: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step),
t AS (SELECT conv_id, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn,
             sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key
      FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_key) AS pos FROM t),
c AS (SELECT conv_id, n, conv_id - conv_id % {trie.BLOCK} AS base, xor(list_reduce(list_prepend(4294967295,
             list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
             lambda a, b: xor(a >> 8, step[1 + (xor(a, b) & 255)])), 4294967295) % {trie.HEADS} AS h
      FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), crc),
m AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
turns AS (SELECT m.conv_id, pos AS depth, turn_key, words FROM m JOIN p ON p.conv_id = m.base AND pos <= h
          UNION ALL SELECT conv_id, pos - h + m, turn_key, words FROM m JOIN p USING (conv_id) WHERE pos > h),
k AS (SELECT conv_id, depth, words, sha256(string_agg(turn_key, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM turns
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
i AS (SELECT *, lag(key) OVER d AS parent, lead(key) OVER d IS NULL AS ends FROM k WINDOW d AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT key, any_value(depth) AS depth, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM i GROUP BY key),
g AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent) USING (key)),
below AS (SELECT a.key, sum((g.n_convs - 1) * g.words) AS saved, count(*) FILTER (n_children = 0) AS leaves
          FROM i AS a JOIN g ON g.conv_id = a.conv_id AND g.depth >= a.depth GROUP BY a.key)
SELECT g.conv_id::BIGINT AS conv_id, g.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, g.n_convs::BIGINT AS n_convs, g.n_children::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, g.ends_sha256
FROM g JOIN below USING (key) LEFT JOIN n AS o ON o.key = g.parent
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
