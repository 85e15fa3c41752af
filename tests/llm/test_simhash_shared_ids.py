"""Near copies where an id occurs on several rows."""

from weft.llm import simhash

A, B, C = ("one two three four five six seven eight", "a wholly different row of words about rivers and mountains", "prices of grain rose again in the autumn of that year")


def kept(spark, rows):
    out = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((r.doc_id, r.text) for r in out.collect())


def test_rows_of_a_shared_id_are_decided_apart(spark):
    assert kept(spark, [(5, A), (5, B), (3, B.upper())]) == [(3, B.upper()), (5, A)]


def test_one_row_of_each_component_stays(spark):
    assert kept(spark, [(3, A), (3, A), (3, B), (4, A), (7, C)]) == [(3, B), (3, A), (7, C)]
    assert len(kept(spark, [(3, A), (3, A.upper()), (3, A + " ")])) == 1
