"""The two-stage exfiltration model: samples of trees, anomalies found, the second stage's say, rows dealt in any way, odd tables."""

import random

from pyspark.sql import functions as F

from fluxwarden.ml.exfil import ExfilModel, SpreadIsolationForest

SCHEMA = "id int, a double, b double, label int"


def rows(n=3_000):
    rng, out = random.Random(1), []
    for i in range(n):
        out.append((i, rng.gauss(0, 1), rng.gauss(0, 1), 0))
    out += [(n + k, 9 + rng.random(), 9 + rng.random(), 1) for k in range(20)] + [(n + 20 + k, -9 - rng.random(), 9 + rng.random(), 0) for k in range(20)]
    return out


def test_two_stages(spark):
    d = spark.createDataFrame(rows(), SCHEMA)
    model = ExfilModel(["a", "b"], "id", trees=30).fit_unsupervised(d.where("id < 3000").repartition(3))
    alone = model.predict(d, F.lit(1.0)).select("id", "exfil.*")
    odd = {r["id"] for r in alone.where("prediction = 'anomaly'").collect()}
    assert set(range(3_000, 3_040)) <= odd and 5 < len(odd - set(range(3_000, 3_040))) < 70
    model.fit_supervised(d, "label", only_anomalous=True, rounds=12, depth=2, rate=0.5)
    got = {r["id"]: r for r in model.predict(d, F.when(F.col("id") == 5, 50.0).otherwise(1.0)).select("id", "exfil.*").collect()}
    assert all(got[i]["prediction"] == "exfil" for i in range(3_000, 3_020)) and all(got[i]["prediction"] == "anomaly" for i in range(3_020, 3_040))
    assert got[5]["trigger"] == "extreme_bytes_ratio" and got[5]["prediction"] == "exfil"


def test_forest_depends_on_the_rows_only(spark):
    d = spark.createDataFrame(rows(600), SCHEMA)
    forests = [SpreadIsolationForest(8, 64).fit(d.repartition(p), ["a", "b"], "id").forest for p in (1, 5)]
    assert forests[0] == forests[1] and len(forests[0]) == 8
    few = SpreadIsolationForest(4, 64).fit(d.limit(10), ["a", "b"], "id")
    assert len(few.forest) == 4
    none = SpreadIsolationForest(4).fit(d.limit(0), ["a", "b"], "id")
    assert {r["anomaly"] for r in none.score(d.limit(3)).collect()} == {0.5}
