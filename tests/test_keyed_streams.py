"""Keyed streams against the batch windows: rows shuffled within and between micro-batches, state that shrinks after its time to live."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fluxwarden.operators import state
from fluxwarden.streaming import keyed

ROW = "flow_id bigint, ts timestamp, src_ip string, port int, reads boolean"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def rows(seed, n=240, closing=True):
    """Rows of a few keys over four hours with ties, long gaps and repeated values; the last one moves the watermark past all others."""
    rng, out, at = random.Random(seed), [], 0.0
    for i in range(n):
        at += rng.choice([0, 0, 1, 20, 90, 119, 120, 200]) if rng.random() < 0.97 else 4000
        out.append((i, START + timedelta(seconds=at), rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(4), rng.random() < 0.1))
    return out + ([(n, START + timedelta(days=30), "end", 0, False)] if closing else [])


def streamed(spark, tmp_path, data, transform, batches=4, late_s=600, seed=0):
    """What the stream gives for rows that come up to ``late_s`` seconds out of order, and its progress reports."""
    rng = random.Random(seed)
    dealt = sorted(data[:-1], key=lambda r: r[1].timestamp() + rng.uniform(0, late_s * 0.9))
    size = -(-len(dealt) // batches)
    for k in range(batches):
        spark.createDataFrame([*dealt[k * size : (k + 1) * size]], ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame(data[-1:], ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    keyed.use_rocksdb(spark)
    out = transform(spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress) == 0
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out"), q.recentProgress


def batch_of(spark, data):
    return spark.createDataFrame(data[:-1], ROW)


def test_history(spark, tmp_path):
    data = rows(1)
    got, progress = streamed(spark, tmp_path, data, lambda s: keyed.history(s, ["flow_id", "port"], "src_ip", n=5, idle_s=3600))
    b = state.with_gap_session(batch_of(spark, data), "_s", ["src_ip"], "ts", ["ts", "flow_id"], 3600)
    want = b.withColumn("h", state.history(["flow_id", "port"], ["src_ip", "_s"], ["ts", "flow_id"], 5))
    assert {r["id"]: [tuple(x) for x in r["history"]] for r in got.collect()} == {r["flow_id"]: [tuple(x) for x in r["h"]] for r in want.collect()}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 10 < max(p["stateOperators"][0]["numRowsTotal"] for p in progress)


def test_first_seen(spark, tmp_path):
    data = rows(2)
    got, _ = streamed(spark, tmp_path, data, lambda s: keyed.first_seen(s, "port", "src_ip"))
    want = state.with_first_seen(batch_of(spark, data), "new", "port", ["src_ip"], ["ts", "flow_id"])
    found = {r["id"]: r["new"] for r in got.collect()}
    assert found == {r["flow_id"]: r["new"] for r in want.collect()} and True in found.values()


def test_sliding_count(spark, tmp_path):
    data = rows(3)
    got, progress = streamed(spark, tmp_path, data, lambda s: keyed.sliding_count(s, "src_ip", window_s=300))
    want = batch_of(spark, data).withColumn("n", state.sliding_count(["src_ip"], "ts", 300))
    assert {r["id"]: r["n"] for r in got.collect()} == {r["flow_id"]: r["n"] for r in want.collect()}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 10


def test_newest_times(spark, tmp_path):
    data = rows(4)
    got, _ = streamed(spark, tmp_path, data, lambda s: keyed.newest_times(s, "src_ip", n=6, ttl_s=3600))
    per = state.newest_times(batch_of(spark, data), ["src_ip"], "ts", 6, 3600)
    want = batch_of(spark, data).withColumn("us", F.unix_micros("ts")).alias("d").join(per.alias("p"), F.expr("d.src_ip <=> p.src_ip and d.us = p.us")).select("flow_id", "times")
    assert {r["id"]: r["times"] for r in got.collect()} == {r["flow_id"]: r["times"] for r in want.collect()}


@pytest.mark.parametrize("n", [3, 200])
def test_read_once(spark, tmp_path, n):
    data = rows(5)
    got, progress = streamed(spark, tmp_path, data, lambda s: keyed.read_once(s, ["flow_id", "port"], "reads", "src_ip", order="flow_id", n=n, ttl_s=120))
    want = state.read_once(batch_of(spark, data), ["flow_id", "port"], "reads", ["src_ip"], "ts", ["ts", "flow_id"], n, 120)
    found = {r["id"]: [tuple(x) for x in r["packets"]] for r in got.collect()}
    assert found == {r["flow_id"]: [tuple(x) for x in r["packets"]] for r in want.collect()} and any(found.values())
    taken = [x for p in found.values() for x in p]
    assert len(taken) == len(set(taken))  # no packet is read twice
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 10
