"""Parts that don't grow with the table."""

import pytest
from pyspark.sql import functions as F

from fluxwarden.ml import models


def test_balanced_deals_no_rows_by_class(spark):
    d = spark.range(2000, numPartitions=4).select(F.col("id"), (F.col("id") % 2).alias("y"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = models.balanced(d, "y")
        assert "SortMergeJoin" not in f._jdf.queryExecution().executedPlan().toString()
        assert f.select("weight").distinct().collect() == [(1.0,)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("rows, parts", [(100, 1), (1000, 10)])
def test_diverse_clusters_parts_of_bounded_size(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(models, "PART_ROWS", 100, raising=False)
    seen, fit = [], models.KMeans.fit

    def recorded(self, df):
        seen.extend(df.rdd.glom().map(len).collect())
        return fit(self, df)

    monkeypatch.setattr(models.KMeans, "fit", recorded)
    d = models.assembled(spark.range(rows, numPartitions=1).select("id", (F.col("id") % 10).cast("double").alias("a")), ["a"])
    assert models.diverse(d, "id", 3).count() == 3
    assert len(seen) == parts and sum(seen) == rows and max(seen) < 200
