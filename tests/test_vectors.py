"""Exact batch search by blocks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basalt.operators import vectors


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("metric", ["l2", "inner", "cosine"])
def test_any_number_of_queries_in_blocks(spark, metric):
    """Over `limit` queries; many equal vectors, so that ties and the last bits of sums count."""
    rng = random.Random(5)
    some = [[rng.gauss(0, 1) for _ in range(9)] for _ in range(40)]
    v = spark.createDataFrame([(i, some[rng.randrange(40)]) for i in range(300)], "id long, v array<float>")
    q = v.filter("id % 3 = 0")
    d = vectors.DISTANCES[metric](F.col("v").cast("array<double>"), F.col("q"))
    pairs = v.crossJoin(q.select(F.col("id").alias("query_id"), F.col("v").cast("array<double>").alias("q"))).select("query_id", "id", d.alias("distance"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter("rank <= 7")
    got = vectors.batch_knn(v, q, 7, metric, limit=30)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_vectors_without_a_distance_come_last(spark):
    v = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [1.0]), (4, [1.0, 2.0]), (5, [3.0, float("nan")])], "id long, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 1.0]), (8, None)], "id long, v array<double>")
    got = vectors.batch_knn(v, q, 4, "inner").select("query_id", "id", "rank")
    assert rows(got) == [(8, 1, 1), (8, 2, 2), (8, 3, 3), (8, 4, 4), (9, 1, 3), (9, 2, 4), (9, 4, 1), (9, 5, 2)]
    assert vectors.batch_knn(v.filter("id < 0"), q, 4).count() == 0 and vectors.batch_knn(v, q.filter("id < 0"), 4).count() == 0
    assert rows(vectors.batch_knn(v.withColumn("id", F.col("id").cast("string")), q, 1, "l2").select("query_id", "id")) == [(8, "1"), (9, "4")]
