"""Queries over models (rows only: SQL can't express them) and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..ml import models
from ..ml.adaptive import AdaptiveForest
from ..ml.boosting import SoftmaxBoosting
from ..operators import storage
from ..sources.flowview import sparse_flows
from ..streaming import twins
from .registry import query

COLUMNS = ["orig_bytes", "resp_bytes", "orig_pkts", "duration_s"]


def _features(spark, sf_dir):
    f = sparse_flows(spark, sf_dir).withColumn("y", (F.col("payload_entropy") > 7).cast("int"))
    return models.balanced(models.assembled(models.scaled(f, models.medians(f, COLUMNS)), COLUMNS), "y")


@query()
def stage1_lr(spark, sf_dir):
    f = _features(spark, sf_dir)
    return models.raw_score(models.stage_one(f, "y").transform(f)).select("flow_id", "z")


@query()
def isolation_forest(spark, sf_dir):
    f = sparse_flows(spark, sf_dir)
    return models.IsolationForest().fit(f, COLUMNS).score(f).select("flow_id", "anomaly")


@query()
def boosted_multiclass(spark, sf_dir):
    """The class with the largest probability, learned from ports and sizes: what a flow's port is used for."""
    f = sparse_flows(spark, sf_dir).withColumn("y", F.when(F.col("orig_bytes") > 400_000, 3).when(F.col("duration_s") < 15, 2).when(F.col("orig_pkts") > 12, 1).otherwise(0))
    model = SoftmaxBoosting(rounds=4, depth=3, rate=0.4, bins=32).fit(f, COLUMNS, "y", 4)
    return model.transform(f).select("flow_id", "y", F.expr("cast(array_position(probabilities, array_max(probabilities)) - 1 as int)").alias("predicted"))


@query()
def adaptive_forest(spark, sf_dir):
    """What the forest said of each flow after it had learned three stretches of days, one by one."""
    f = sparse_flows(spark, sf_dir).withColumn("y", (F.col("orig_bytes") > 300_000).cast("int")).withColumn("day", F.dayofmonth("ts"))
    forest = AdaptiveForest(COLUMNS, 2, trees=3, bins=16)
    for k in range(3):
        forest.learn(f.where(F.col("day").between(1 + 10 * k, 10 + 10 * k)), "y", "flow_id")
    return forest.transform(f).select("flow_id", "y", (F.col("probabilities")[1] > 0.5).alias("large"))


@query()
def kmeans_diverse(spark, sf_dir):
    return models.diverse(_features(spark, sf_dir), "flow_id", 8)


def _streamed(spark, sf_dir, transform, mode="append"):
    """Reads events as a file stream, runs the transformation until no input is left, and returns what it wrote: a file sink, or in complete mode the
    last whole result."""
    base = f"{storage.shared_dir(spark).rstrip('/')}/fluxwarden/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet" if not sf_dir.endswith("*") else sf_dir)
    out = transform(source)
    writer = out.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/state")
    if mode == "complete":
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    else:
        q = writer.format("parquet").start(f"{base}/out")
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query("select date_trunc('day', ts) as start, count(*) as n from events group by 1")
def stream_timeline(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: twins.timeline(s, "ts", "1 day"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""select user_id::varchar as key, event_id, n from (select *, count(*) over (partition by user_id, date_trunc('day', ts) order by ts, event_id rows unbounded preceding) as n from events) where n>=4""")
def stream_running_alerts(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: twins.running_alerts(s, "user_id", "ts", 86400, 4))
