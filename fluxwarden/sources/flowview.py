"""The driver's tables seen as flows: sparse ones from events, dense ones from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARSE_SQL = """
select event_id as flow_id, ts,
  concat('10.0.', cast(cast(floor(user_id/256) as int) as varchar), '.', cast(user_id % 256 as varchar)) as src_ip,
  case when event_type in ('click','view','error') then concat('10.1.0.', cast(event_id % 50 as varchar))
       when event_type = 'purchase' then '8.8.8.8'
       else concat('198.51.100.', cast(event_id % 20 as varchar)) end as dst_ip,
  cast(case cast(regexp_extract(props,'([0-9]+)',1) as int) % 6
       when 0 then 22 when 1 then 3389 when 2 then 445 when 3 then 443 when 4 then 853 else 8888 end as int) as dst_port,
  cast(round(value*10000) as bigint) as orig_bytes,
  cast((event_id*7919) % 100000 as bigint) as resp_bytes,
  cast(1 + event_id % 20 as bigint) as orig_pkts,
  cast(event_id % 600 as double)/10 as duration_s,
  6.0e0 + cast(regexp_extract(props,'([0-9]+)',1) as double)/50 as payload_entropy
from events
"""
DENSE_SQL = """
select l_orderkey*10+l_linenumber as flow_id, l_shipdate as ts, cast(l_suppkey as varchar) as src, cast(l_orderkey % 500 as varchar) as dst,
  cast(l_partkey % 1024 as int) as port, cast(round(l_extendedprice) as bigint) as bytes
from lineitem
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sparse_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1)
    port = k.cast("int") % 6
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("flow_id"), "ts",
        F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("int").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string")).alias("src_ip"),
        F.when(F.col("event_type").isin("click", "view", "error"), F.concat(F.lit("10.1.0."), (F.col("event_id") % 50).cast("string")))
        .when(F.col("event_type") == "purchase", "8.8.8.8").otherwise(F.concat(F.lit("198.51.100."), (F.col("event_id") % 20).cast("string"))).alias("dst_ip"),
        F.when(port == 0, 22).when(port == 1, 3389).when(port == 2, 445).when(port == 3, 443).when(port == 4, 853).otherwise(8888).alias("dst_port"),
        F.round(F.col("value") * 10000).cast("long").alias("orig_bytes"),
        ((F.col("event_id") * 7919) % 100000).cast("long").alias("resp_bytes"),
        (1 + F.col("event_id") % 20).cast("long").alias("orig_pkts"),
        ((F.col("event_id") % 600).cast("double") / 10).alias("duration_s"),
        (F.lit(6.0) + k.cast("double") / 50).alias("payload_entropy"),
    )


def dense_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("flow_id"), F.col("l_shipdate").alias("ts"), F.col("l_suppkey").cast("string").alias("src"),
        (F.col("l_orderkey") % 500).cast("string").alias("dst"), (F.col("l_partkey") % 1024).cast("int").alias("port"), F.round("l_extendedprice").cast("long").alias("bytes"),
    )
