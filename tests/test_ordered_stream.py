"""The forward filter over event time: files in any order give the batch result, and no key's micro-batch becomes one frame."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import hmm as M
from weft.session import scratch_path
from weft.streaming import streams

DIE = M.Model((0.5, 0.5), ((0.7, 0.3), (0.3, 0.7)), ((0.9, 0.1), (0.2, 0.8)))
SCHEMA = "k string, t timestamp, e int, sym int"
START = datetime.datetime(2024, 1, 1)


def test_forward_steps_one_by_one():
    rng = np.random.default_rng(1)
    steps, v, want = rng.random((200, 3, 3)), np.array([0.2, 0.3, 0.5]), []
    for m in steps:
        v = v @ m / (v @ m).sum()
        want.append(v)
    for width in (1, 7, 64, 500):
        assert np.allclose(streams.forward_steps(np.array([0.2, 0.3, 0.5]), steps, width), want)
    assert (streams.forward_steps(np.zeros(3), steps) == 0).all()


@pytest.mark.parametrize("slot", [60, 86_400])
def test_shuffled_files_give_the_batch_result(spark, slot):
    pick, folder = random.Random(4), scratch_path(spark, "events")
    rows = [("hot" if pick.random() < 0.7 else f"u{pick.randint(0, 3)}", START + datetime.timedelta(seconds=pick.randint(0, 7200)), i, pick.randint(0, 1)) for i in range(300)]
    rows += [("odd", START, 900, None), ("odd", START, 901, 7), (None, START, 902, 1), (None, START, 903, 0)]
    mixed = pick.sample(rows, len(rows))
    for part in range(3):
        spark.createDataFrame(mixed[part::3], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    end, last_folder = streams.closing(spark, spark.createDataFrame([], SCHEMA).schema)
    events = streams.file_stream(spark, folder, SCHEMA).unionByName(end)
    out = streams.hmm_filter_stream(events, "k", ["t", "e"], "sym", DIE, delay="3 hours", slot_seconds=slot)
    last = spark.createDataFrame([("odd", START + datetime.timedelta(days=9), 999, None)], SCHEMA)
    got = streams.run_closed(spark, out, "f", last_folder, last).collect()
    want = M.hmm_forward(spark.createDataFrame(rows, SCHEMA).where("k IS NOT NULL"), "k", ["t", "e"], "sym", DIE).collect()
    key = lambda r: (r["k"], r["step"])
    named = sorted((r for r in got if r["k"] is not None), key=key)
    assert [key(r) for r in named] == sorted(key(r) for r in want)
    assert np.allclose([r["f"] for r in named], [r["f"] for r in sorted(want, key=key)])
    assert sorted(r["step"] for r in got if r["k"] is None) == [0, 1]


def test_rows_wait_for_the_watermark(spark):
    """Without a later time the last slot stays in the state."""
    folder = scratch_path(spark, "events")
    rows = [("a", START + datetime.timedelta(minutes=m), m, m % 2) for m in range(30)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(folder)
    out = streams.hmm_filter_stream(streams.file_stream(spark, folder, SCHEMA), "k", ["t", "e"], "sym", DIE, delay="5 minutes", slot_seconds=600)
    got = streams.run_to_table(spark, out, "f")
    assert got.agg(F.max("step")).first()[0] == 19  # the watermark stands at minute 24
