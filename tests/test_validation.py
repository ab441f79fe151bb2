"""Each check of the validator on a planted fault and on sound data; the gate of the grid search; the ablation."""

import random

import pytest
from pyspark.sql import functions as F

from fluxwarden.ml import validation

SCHEMA = "flow_id int, t int, a double, b double, c double, y int"
FEATURES = ["a", "b", "c"]


def rows(seed, n=900, noise=0.02):
    rng, out = random.Random(seed), []
    for i in range(n):
        a, b = rng.random(), rng.random()
        y = int(a > 0.5)
        out.append((i, i, a, b, rng.random(), 1 - y if rng.random() < noise else y))
    return out


def fast(features=FEATURES, label="y", **how):
    return validation.boosted(features, label, rounds=2, depth=2, rate=0.8, bins=16, **how)


def validator(df, **how):
    return validation.Validator(df, how.pop("features", FEATURES), "y", "flow_id", "t", how.pop("trainer", fast()), folds=2)


@pytest.fixture(scope="module")
def sound(spark):
    return spark.createDataFrame(rows(1), SCHEMA)


def last(v):
    return v.rows[-1][2]


def test_sound_data_passes(spark, sound):
    report = validator(sound).all(spark.createDataFrame(rows(2, 300), SCHEMA)).collect()
    assert [r["check"] for r in report] == list(validation.CHECKS) and not [r for r in report if r["failed"]]
    assert report[-1]["note"] == "a"


def test_each_check_fires_on_its_fault(spark, sound):
    v = validator(sound.withColumn("b", F.col("b") + F.when(F.col("t") > 720, 1.0).otherwise(0.0)))
    assert v.leakage() > 0.9 and last(v)
    v = validator(sound.withColumn("b", F.lit(3.0)).withColumn("c", F.col("y") * 2.0))
    assert v.distributions() == 2 and last(v)
    v = validator(sound.withColumn("b", F.when(F.col("t") % 20 == 0, F.col("b")).otherwise(0.0)))
    assert v.distributions() == 1 and last(v)
    v = validator(sound.withColumn("y", (F.col("t") < 5).cast("int")))
    assert v.balance() > 100 and last(v)
    noise = sound.withColumn("y", (F.pmod(F.xxhash64("flow_id"), F.lit(2))).cast("int"))
    v = validator(noise)
    v.learning_curve((1.0,))
    assert last(v)
    v = validator(sound)
    assert v.calibration(fast()(sound.withColumn("y", 1 - F.col("y"))), sound) > 0.3 and last(v)
    v = validator(sound.withColumn("y", F.when(F.pmod(F.xxhash64("flow_id"), F.lit(1000)) < F.col("t"), 1 - F.col("y")).otherwise(F.col("y"))))
    assert v.temporal(fast()(sound)) < -0.05 and last(v)
    v = validator(sound)
    assert v.cross_dataset(sound.withColumn("a", 1 - F.col("a"))) > 0.5 and last(v)
    ids = sound.withColumn("y", (F.col("flow_id") > 400).cast("int"))
    v = validator(ids, features=["flow_id", "a"], trainer=fast(["flow_id", "a"]))
    assert v.importance(v.trainer(ids))[0][0] == "flow_id" and last(v)
    assert v.report(spark).count() == 1


def test_grid_search_refuses_the_best_f1_below_the_gate(spark, sound):
    unknown = spark.createDataFrame(rows(3, 400), SCHEMA)

    def fixed(threat):
        return lambda _: lambda d: d.withColumn("probability", F.when(threat, 1.0).otherwise(0.0)).withColumn("prediction", threat.cast("int"))

    trainers = {"precise": fixed((F.col("y") == 1) & (F.pmod(F.xxhash64("flow_id"), F.lit(100)) < 60)), "eager": fixed(F.lit(True)), "good": fixed((F.col("y") == 1) & (F.pmod(F.xxhash64("flow_id"), F.lit(100)) < 97))}
    name, _, table = validation.grid_search(sound, unknown, trainers, "y")
    assert name == "good" and dict((t[0], t[1] >= 0.65) for t in table) == {"precise": False, "eager": True, "good": True}
    assert validation.grid_search(sound, unknown, {"precise": trainers["precise"]}, "y", fallback=trainers["eager"])[0] is None
    assert validation.grid_search(sound, unknown, {"precise": trainers["precise"]}, "y")[0] == "precise"


def test_ablation(spark, sound):
    got = validation.ablation(sound, spark.createDataFrame(rows(4, 300), SCHEMA), {"whole": FEATURES, "without a": ["b", "c"]}, {"boosted": fast, "stumps": lambda f: validation.boosted(f, "y", rounds=2, depth=1, rate=0.6, bins=8)}, "y").collect()
    f1 = {(r["model"], r["features"]): r["f1"] for r in got}
    assert len(f1) == 4 and f1["boosted", "whole"] > 0.9 > f1["boosted", "without a"]
