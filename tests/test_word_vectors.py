"""The stored vectors that stand for words."""

import pytest
from pyspark.sql import functions as F

from weft.plans import models
from weft.plans.registry import QUERIES
from weft.plans.roles import vectors


def test_nearly_all_vectors_are_joined(spark, sf):
    stored = vectors(spark, sf)
    own = stored.select("vec_id", F.col("vec_id").alias("cluster"))
    hit = models.doc_bins(spark, sf, own).where("n > 0").select("cluster").distinct().count()
    assert hit > 0.99 * stored.count()


@pytest.mark.parametrize("name, seen", [("index_documents", "v"), ("lookup_word_vectors", "v"), ("neighbour_counts", "vec_id")])
def test_queries_read_nearly_all_vectors(spark, sf, name, seen):
    assert QUERIES[name](spark, sf).select(seen).distinct().count() > 0.99 * vectors(spark, sf).count()
