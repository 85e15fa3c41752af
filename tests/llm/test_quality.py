from collections import Counter

import duckdb
from compare import mismatch
from hypothesis import given
from hypothesis import strategies as st

from weft.llm import quality, queries


def brute(text):
    words, word = [], ""
    for ch in text + " ":
        if ch in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += ch
    grams = Counter(zip(words, words[1:], words[2:]))
    repeat = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(repeat)


@given(st.text(alphabet="ab \n\t# é ", max_size=60))
def test_measures(text):
    assert quality.measure(text) == brute(text)


def test_edge_rows(edge, no_rows):
    out = quality.quality(edge).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == Counter((r.doc_id, *brute(r.text or "")) for r in edge.collect())
    assert all(r.base_failed or not r.kept or r.n_words >= 50 for r in out) and not any(r.base_failed and r.kept for r in out)
    assert quality.quality(no_rows).count() == 0 and quality.keep_good(no_rows).count() == 0


def test_rejected_host_keeps_clean_documents(spark):
    good = " ".join(f"w{i}" for i in range(80))
    faulty = good + " ### $$$ ***" * 5
    rows = [(i, "short", "bad") for i in range(300)] + [(1000, good, "bad"), (1001, faulty, "bad")]
    rows += [(2000 + i, faulty if i % 2 else good, "fine") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.quality(df).where("kept").collect()}
    assert kept == {1000, *range(2000, 2300)}
    assert {r.doc_id for r in quality.keep_good(df).collect()} == kept


def test_stage_keeps_columns(edge):
    assert quality.keep_good(edge).columns == edge.columns


def test_query_and_statement_on_hosts_of_both_kinds(spark, tmp_path):
    """A table with one bad host among many: its faulty documents go, others' stay; the statement says the same."""
    good = " ".join(f"w{i}" for i in range(80))
    faulty = good + " ### $$$ ***" * 5
    rows = [(1000 * h + i, "too short" if i % 20 < (14 if h == 3 else 2) else faulty if i % 3 else good, f"host{h}") for h in range(12) for i in range(200)]
    rows += [(99_000 + i, good, None) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op9_quality_rules"](spark, str(tmp_path))
    gone = {r.doc_id // 1000 for r in got.where("NOT base_failed AND NOT kept").collect()}
    assert gone == {3} and got.where("kept AND doc_id BETWEEN 3000 AND 3999").count() > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert mismatch(got, queries.ORACLES["op9_quality_rules"], con) is None


def test_equal_hosts_are_not_rejected(spark):
    hosts = spark.createDataFrame([(f"h{i}", 500, 50 + i) for i in range(20)], "host string, n long, n_failed long")
    assert not any(r.rejected for r in quality.host_verdicts(hosts).collect())
