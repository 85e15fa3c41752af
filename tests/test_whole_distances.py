"""Distance queries give every pair, whatever its distance."""

import datetime

import __spark_entry__


def test_far_paths_are_named(spark, tmp_path):
    """Forty courses in opposite order differ in all their 780 pairs."""
    day = datetime.datetime(2024, 1, 1, 12)
    rows = [
        (user, day + datetime.timedelta(days=7 * (k if user == 1 else 39 - k)), 100 * user + k, "view", 1.0, f'{{"k": {10 * k}}}')
        for user in (1, 2) for k in range(40)
    ] + [(3, day, 900, "view", 1.0, '{"k": 0}')]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["i"], r["j"]): r["dist"] for r in __spark_entry__.queries()["path_dist_order"](spark, str(tmp_path)).collect()}
    assert got[1, 2] == 780 and set(got) == {(1, 2), (1, 3), (2, 3)}


def test_far_documents_are_named(spark, tmp_path):
    """Documents that share few words or none are at a distance too; a copy stands by its first one."""
    texts = ["red green blue", "red white black grey", "north south", "red green blue"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["i"], r["j"]): r for r in __spark_entry__.queries()["dist_cosine"](spark, str(tmp_path)).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2), (0, 3)}
    assert got[0, 2]["dist"] == got[1, 2]["dist"] == 1 and 0.7 < got[0, 1]["dist"] < 1 and got[0, 3]["dist"] == 0
    assert (got[0, 1]["n_i"], got[0, 1]["n_j"]) == (2, 1) and (got[1, 2]["n_i"], got[1, 2]["n_j"]) == (1, 1)
