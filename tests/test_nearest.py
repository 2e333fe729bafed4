"""The nearest vectors of many queries against the plain expressions."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.operators import ranking


def _plain(vectors, queries, k):
    pairs = vectors.crossJoin(queries.select("query_id", F.col("embedding").alias("q")))
    scored = pairs.select("query_id", "vec_id", F.round(ranking.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _rows(df):
    return sorted(map(str, df.select("query_id", "vec_id", "score", "rank").collect()))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_with_copies_near_copies_and_odd_vectors(spark, kind, monkeypatch):
    monkeypatch.setattr(ranking, "VECTORS", 1 << 9)
    monkeypatch.setattr(ranking, "QUERIES", 8)
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(700, 6)).tolist() + [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 150
    rows += (np.array([3.0, 1.0, 2.0, 0.5, 0.25, 1.0]) * (1 + rng.normal(size=(150, 6)) * 1e-6)).tolist()
    rows += [[0.0] * 6] * 9 + [[1.0, 2.0], None, [], [None] * 6, [float("nan")] * 6, [float("inf")] + [1.0] * 5, [1e-38] * 6]
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"vec_id long, embedding array<{kind}>")
    queries = vectors.filter("vec_id % 70 = 0 or vec_id >= 995").select(F.col("vec_id").alias("query_id"), "embedding")
    assert _rows(ranking.dense_many(vectors, queries, 5)) == _rows(_plain(vectors, queries, 5))


def test_fewer_vectors_than_asked_for(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    queries = vectors.select(F.col("vec_id").alias("query_id"), "embedding")
    assert _rows(ranking.dense_many(vectors, queries, 5)) == _rows(_plain(vectors, queries, 5))
    assert ranking.dense_many(vectors.limit(0), queries, 5).count() == 0


def test_no_pair_of_query_and_relevant_item_is_made(spark):
    """Equal labels: the pairs would be the square of the items."""
    n = 200_000
    items = spark.range(n).select(F.col("id").alias("item"), F.lit(1).alias("label"))
    ranked = spark.range(n).select(F.col("id").alias("query_id"), F.col("id").alias("item"), F.lit(1).alias("rank"))
    found = ranking.metrics_by_label(ranked, items.withColumnRenamed("item", "query_id"), items, 10)
    assert found.agg(F.count("*"), F.min("recall"), F.min("mrr"), F.max("precision")).first() == (n, 5e-6, 1.0, 0.1)


def test_metrics_by_label_as_by_pairs(spark):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "item long, label string")
    queries = items.withColumnRenamed("item", "query_id")
    ranked = spark.createDataFrame([(q, (q + r) % 5, r) for q in (1, 2, 3, 4) for r in (1, 2)], "query_id long, item long, rank int")
    pairs = queries.join(items, "label").select("query_id", "item")
    assert sorted(ranking.metrics_by_label(ranked, queries, items, 2).collect()) == sorted(ranking.metrics(ranked, pairs, 2).collect())
