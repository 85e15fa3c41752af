from collections import Counter

import pytest
from duckdb import connect

import __spark_entry__ as entry
from weft.llm import dedup, packing, quality, secrets, simhash
from weft.llm.queries import ORACLES, QUERIES

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_queries_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "packing"]


def test_pipeline_against_plain_steps(spark, sf):
    """The rows of run() are those of the same decisions taken from the operators' own results, step by step."""
    docs = [tuple(r) for r in connect().sql(f"SELECT doc_id, text, source FROM '{sf}/documents.parquet'").fetchall()]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    good = {r.doc_id for r in quality.quality(frame(docs)).where("kept").collect()}
    docs = [d for d in docs if d[0] in good]
    last = {}
    for d in docs:
        last[d[1]] = max(d[0], last.get(d[1], d[0]))
    docs = [d for d in docs if last[d[1]] == d[0]]
    assert {r.doc_id for r in dedup.drop_copies(frame(docs)).collect()} == {d[0] for d in docs}
    names = {r.doc_id: r.component_id for r in simhash.near_groups(frame(docs)).collect()}
    docs = [d for d in docs if names[d[0]] == d[0]]
    scanner = secrets.Scanner(secrets.dictionary(secrets.identifiers(frame(docs).select("doc_id", "text"))))
    docs = [(i, secrets.masked(t, scanner.scan(t)), s) for i, t, s in docs]
    import public_tokenizers

    want = packing.packed(frame(docs), public_tokenizers.path("byte_bpe_50k.json")).collect()
    got = corpus_pipeline.run(spark, sf).collect()
    total = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows for _ in range(r.length))
    assert total(got) == total(want)


def test_stages_on_edge_rows(spark, edge, no_rows, sf):
    for start in (edge, no_rows):
        docs = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = corpus_pipeline.cut(stage(spark, docs, sf))
            assert k == 4 or docs.columns == edge.columns
        assert docs.columns[:3] == ["doc_id", "start", "length"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:], 1):
        out = stage(spark, edge, sf)
        assert out.count() and (k == 4 or out.columns == edge.columns)
