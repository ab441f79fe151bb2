"""The adaptive forest: it learns, recovers after a planted shift of the classes, counts alike however rows are dealt, and learns from a stream."""

import random

import numpy as np
from pyspark.sql import functions as F

from fluxwarden.ml.adaptive import AdaptiveForest, poisson

SCHEMA = "t int, a double, b double, c double, y int"


def batch(k, n=1_500, shifted=False):
    rng, out = random.Random(k), []
    for i in range(n):
        a, b = rng.random(), rng.random()
        y = int(a > 0.5) if not shifted else int(b < 0.4)
        out.append((k * n + i, a, b, rng.random(), y))
    return out


def test_recovers_after_a_shift(spark):
    forest = AdaptiveForest(["a", "b", "c"], 2, trees=5, bins=16)
    share = []
    for k in range(14):
        n, right = forest.learn(spark.createDataFrame(batch(k, shifted=k >= 7), SCHEMA).repartition(3), "y", "t")
        share.append(right / n)
    assert share[6] > 0.9 and share[7] < 0.7 and share[13] > 0.85, share
    assert forest.drifts and all(b >= 7 for b, _ in forest.drifts)
    new = forest.transform(spark.createDataFrame(batch(99, 300, True), SCHEMA))
    assert new.where((F.col("probabilities")[1] > 0.5).cast("int") == F.col("y")).count() >= 250
    assert all(len(t.counts) <= forest.most_leaves for t in forest.forest)
    assert forest.learn(new.limit(0), "y", "t") == (0, 0)


def test_rows_may_be_dealt_in_any_way(spark):
    found = []
    for parts in (1, 4):
        forest = AdaptiveForest(["a", "b", "c"], 2, trees=3, bins=8)
        for k in range(2):
            forest.learn(spark.createDataFrame(batch(k, 800), SCHEMA).repartition(parts), "y", "t")
        found.append([(t.feature, t.cut, sorted((k, c.tolist()) for k, c in t.counts.items())) for t in forest.forest])
    assert found[0] == found[1]
    w = poisson(np.arange(200_000), 3)
    assert abs(w.mean() - 6) < 0.05 and abs(w.var() - 6) < 0.15


def test_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame(batch(k, 500), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    forest, told = AdaptiveForest(["a", "b", "c"], 2, trees=3, bins=8), []
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    forest.writer(stream, "y", "t", lambda *x: told.append(x)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [x[1] for x in told] == [500, 500, 500] and told[2][2] > 400
