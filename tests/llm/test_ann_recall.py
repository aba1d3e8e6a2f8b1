"""Nearest vectors are found for queries and vectors unlike most of the rows."""

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm import ann


def _recall(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, total = 0, 0
    for q in ann.nearest(df, F.col("id") % 20 == 0).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect():
        s = x @ x[q["query_id"]]
        s[q["query_id"]] = -np.inf
        found, total = found + len(set(q["v"]) & set(np.argsort(-s)[:20].tolist())), total + 20
    assert total == 20 * -(-len(x) // 20)
    return found / total


def test_ann_queries_unlike_the_rows(spark):
    r, n = np.random.default_rng(5), 8000
    x = np.hstack([(r.normal(size=(40, 8)) * 5)[r.integers(40, size=n)], r.normal(size=(n, 24)) * 0.3])  # clusters, and noise
    asked = np.arange(n) % 20 == 0
    x[asked, :8], x[asked, 8:] = 0, r.normal(size=(asked.sum(), 24))  # queries only see the noise
    assert _recall(spark, x) >= 0.95


def test_ann_rare_long_vectors(spark):
    r, n = np.random.default_rng(6), 8000
    x = r.normal(size=(n, 32))
    x[r.random(n) < 0.003] *= 50
    assert _recall(spark, x) >= 0.95
