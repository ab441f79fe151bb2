"""Calibration by folds, noise that doesn't depend on the dealing, adapters of the second family, logs with different fields, look-up by id."""

import random

import pytest
from pyspark.sql import functions as F

from fluxwarden.ml import metrics, models
from fluxwarden.operators import store
from fluxwarden.sources import adapters, readers


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_calibration_by_folds(spark, method):
    rng = random.Random(3)
    d = spark.createDataFrame([(i, x := rng.random(), int(rng.random() < x * x)) for i in range(1_500)], "id int, x double, y int")
    trained = []

    def train(rows):
        trained.append(rows.count())
        return lambda r: r.withColumn("z", 10 * F.col("x") - 5)

    found = models.calibrated_by_folds(d, "y", "id", train, method)(d)
    assert len(trained) == 5 and all(1_100 < n < 1_300 for n in trained) and found.columns == ["id", "x", "y", "probability"]
    error = found.agg(F.avg(F.abs(F.col("probability") - F.col("x") * F.col("x")))).first()[0]
    assert error < 0.08
    assert found.agg(F.avg("probability") - F.avg("y")).first()[0] == pytest.approx(0, abs=0.03)


def test_noise_is_of_the_row(spark):
    d = spark.range(4_000).select("id", (F.col("id") % 100).cast("double").alias("a"))
    got = [{r["id"]: r["a"] for r in metrics.with_noise(d.repartition(p), ["a"], 0.5, key="id").collect()} for p in (1, 7)]
    assert got[0] == pytest.approx(got[1], rel=1e-9)  # the spread is summed in another order
    diff = metrics.with_noise(d, ["a"], 0.5).withColumnRenamed("a", "b").join(d, "id").agg(F.stddev_pop(F.col("b") - F.col("a")).alias("s"), F.avg(F.col("b") - F.col("a")).alias("m")).first()
    assert diff["s"] == pytest.approx(0.5 * 28.866, rel=0.05) and abs(diff["m"]) < 1


def test_second_family(spark):
    raw = spark.createDataFrame([("100", "x", "Botnet"), (None, "5", "Odd")], "orig_bytes string, `id.resp_p` string, label string")
    got = adapters.connection_log(raw).collect()
    assert [(r["orig_bytes"], r["dport"], r["bytes_ratio"], r["label"], r["dataset_source"]) for r in got] == [(100.0, None, 100.0, 1, "CTU13"), (None, 5.0, None, None, "CTU13")]
    raw = spark.createDataFrame([("BENIGN", "2000000", "7", "1"), ("DDoS", "1", "1", "1")], "Label string, `Flow Duration` string, `Total Length of Fwd Packets` string, `Total Length of Bwd Packets` string")
    (r,) = adapters.flow_meter(raw).collect()
    assert (r["duration_s"], r["total_bytes"], r["bytes_ratio"], r["iat_cv"], r["label"], r["has_timing_features"]) == (2.0, 8.0, 3.5, None, 0, True)
    got = adapters.dns_exfil(spark.createDataFrame([("abc.x9.example.com", "tunnel"), (None, None)], "query string, label string")).collect()
    assert [r["label"] for r in got] == [2, 0] and got[0]["has_dns_features"]


def test_logs_with_different_fields_are_an_error(spark, tmp_path):
    (tmp_path / "a.log").write_text("#fields\tts\tduration\n1\t2\n")
    (tmp_path / "b.log").write_text("#fields\tduration\tts\n1\t2\n")
    assert readers.zeek_log(spark, str(tmp_path / "a.log")).first()["duration"] == "2"
    with pytest.raises(ValueError, match="different fields"):
        readers.zeek_log(spark, str(tmp_path))


def test_alert_by_id(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "alert_id string, flow_id int")
    f = spark.createDataFrame([(1, "s"), (2, "t")], "flow_id int, src_ip string")
    assert [r["src_ip"] for r in store.list_alerts(a, f, alert_id="y").collect()] == ["t"]


def test_smallest_hashes(spark):
    import hashlib

    from fluxwarden.ml import split

    rng = random.Random(5)
    rows = [(i % 900, rng.choice(["a"] * 9 + ["b", None])) for i in range(1_000)]
    d = spark.createDataFrame(rows, "id int, y string").repartition(4)
    for n in (0, 1, 37, 500, 5_000):
        want = []
        for y in ("a", "b", None):
            own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, k in rows if k == y)
            want += [(i, y) for _, i in own[:n]]
        got = [tuple(r) for r in split.smallest_hashes(d, "y", "id", F.lit(n)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
