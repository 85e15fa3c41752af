"""A table in few files is spread over tasks whose number grows with it."""

import os

from weft import session


def test_parts_grow_with_the_files(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "a table")
    spark.range(5000).coalesce(1).write.parquet(at)
    df, cores = spark.read.parquet(at), spark.sparkContext.defaultParallelism
    assert session.widen(df, "id").rdd.getNumPartitions() == cores
    size = sum(os.path.getsize(f"{at}/{f}") for f in os.listdir(at) if f.endswith(".parquet"))
    monkeypatch.setattr(session, "PART", 500)
    wide = session.widen(df, "id")
    assert wide.rdd.getNumPartitions() == -(-size // 500) > cores
    assert sorted(r[0] for r in wide.collect()) == list(range(5000))
