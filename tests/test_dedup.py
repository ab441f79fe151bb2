"""De-duplication with a time to live against the greedy loop: one key with most rows, ties, null keys and times, slices of any width; no Python in its plan."""

import random

import pytest
from pyspark.sql import functions as F

from fluxwarden.operators import state


def greedy(rows, ttl):
    want, opened = set(), {}
    for i, k, s in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if k not in opened or s - opened[k] >= ttl:
            opened[k] = s
            want.add(i)
    return want


@pytest.mark.parametrize(("ttl", "slice_s"), [(60, None), (60, 10), (600, 700), (1, 3), (100_000, None)])
def test_against_the_loop(spark, ttl, slice_s):
    rng = random.Random(ttl)
    rows = [(i, rng.choice(["hot"] * 9 + ["a", "b", None]), rng.choice([rng.randrange(3_000), 20_000 + rng.randrange(500), 50_000, None])) for i in range(1_500)]
    d = spark.createDataFrame(rows, "id int, k string, s bigint").withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    got = state.dedup_ttl(d, "k", "ts", ["ts", "id"], ttl, slice_s)
    found = [r["id"] for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == greedy(rows, ttl) and got.columns == d.columns
    assert state.dedup_ttl(d.limit(0), "k", "ts", ["ts", "id"], ttl).count() == 0


def test_hot_key_is_sorted_in_slices(spark):
    """Nine rows in ten are of one key: no slice of it holds more than its share of time, and the plan has neither Python nor a window over a whole key's rows."""
    d = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("_k"), (F.col("id") * 1_000_000).alias("us")).select(F.struct(F.col("_k").alias("key")).alias("_k"), "us")
    linked = state._next_times(d, 60_000_000, 640)
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    per = linked.groupBy("_k", F.floor(F.col("us") / 640_000_000)).count().agg(F.max("count")).first()[0]
    assert per <= 640
    assert {(r["us"] // 1_000_000, r["nxt"] // 1_000_000) for r in linked.where("_k.key = 'hot' and us < 100000000").collect()} == {(i, i + 60 + ((i + 60) % 10 == 0)) for i in range(100) if i % 10}
