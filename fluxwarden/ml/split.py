"""Splits and samples that don't depend on how rows are dealt: order comes from a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import order as order_


def time_split(df: DataFrame, order: list[str], shares: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    """``df`` plus split: train, validation, test by time (the first of ``order``), cut at floor(share * n)."""
    ranged = order_.with_row_number(df, order_.micros(F.col(order[0])), order)
    at = lambda k: F.col("_rn") <= F.floor(F.lit(shares[k]) * F.col("_rn_total"))
    return ranged.withColumn("split", F.when(at(0), "train").when(at(1), "validation").otherwise("test")).drop("_rn", "_rn_total")


def group_holdout(df: DataFrame, key: str, percent: int = 25) -> DataFrame:
    """``df`` plus test: whole groups, by the md5 of the key."""
    share = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("long") % 100
    return df.withColumn("test", share < percent)


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8) -> DataFrame:
    """``df`` plus train: the smallest hashes of each class, floor(share * n) of them. Classes are cut at exact quantiles of the hash, so no
    class is sorted in one task."""
    hashed = df.withColumn("_h", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("long"))
    sizes = hashed.groupBy(label, F.floor(F.col("_h") / F.lit(float(1 << 38))).cast("int").alias("_slot")).agg(F.count("*").alias("_n"))  # 1,024 slots a class at most
    w = Window.partitionBy(label).orderBy("_slot")
    sizes = sizes.select(label, "_slot", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    d = hashed.withColumn("_slot", F.floor(F.col("_h") / F.lit(float(1 << 38))).cast("int")).join(sizes, [label, "_slot"])
    rn = F.row_number().over(Window.partitionBy(label, "_slot").orderBy("_h", key)) + F.col("_before")
    return d.withColumn("train", rn <= F.floor(F.lit(share) * F.col("_all"))).drop("_h", "_slot", "_before", "_all")


def smallest_hashes(df: DataFrame, label: str, key: str, n: Column) -> DataFrame:
    """Of each class the ``n`` rows with the smallest hashes of the key. Hashes are dealt to 4096 slots, whose sizes say which of them are taken whole; rows are numbered
    in the one slot of a class that is taken in part, so a large class isn't sorted by one task."""
    h = F.md5(F.col(key).cast("string"))
    d = df.withColumn("_h", h).withColumn("_slot", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    w = Window.partitionBy(label).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(label, "_slot").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    sizes = sizes.where(F.col("_before") < n).select(F.col(label).alias("_of"), F.col("_slot").alias("_in"), "_n", "_before")
    d = d.join(sizes, d[label].eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_in")))
    part = d.where(F.col("_before") + F.col("_n") > n)
    part = part.withColumn("_rn", F.row_number().over(Window.partitionBy(label, "_slot").orderBy("_h", key))).where(F.col("_rn") + F.col("_before") <= n)
    return d.where(F.col("_before") + F.col("_n") <= n).select(*df.columns).unionByName(part.select(*df.columns))


def balanced_mix(batch: DataFrame, buffer: DataFrame, label: str, key: str) -> DataFrame:
    """A batch with rows of a replay buffer: of each class as many as a third of the batch at most, the smallest hashes first."""
    return batch.unionByName(smallest_hashes(buffer, label, key, F.lit(batch.count() // 3)))


def downsample(df: DataFrame, label: str, key: str, ratio: int, minority=1) -> DataFrame:
    """All rows of the minority class and ``ratio`` times as many of the others, the smallest hashes first."""
    most = ratio * df.where(F.col(label) == minority).count()
    order = [F.md5(F.col(key).cast("string")), F.col(key)]
    rest = df.where(F.col(label) != minority).orderBy(*order).limit(most)
    return df.where(F.col(label) == minority).unionByName(rest)


def oversample(df: DataFrame, label: str, most: int = 20_000) -> DataFrame:
    """Rows repeated so that every class comes near to the largest (``most`` at most)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    target = F.least(F.max("_n").over(Window.partitionBy()), F.lit(most))
    sizes = sizes.select(label, F.greatest(F.lit(1), F.floor(target / F.col("_n"))).cast("int").alias("_times"))
    return df.join(sizes, label).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


def replay_buffer(df: DataFrame, label: str, order: list, n: int = 10_000) -> DataFrame:
    """The newest n rows of each class."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def uncertain(df: DataFrame, entropy, key: str, n: int) -> DataFrame:
    return df.withColumn("uncertainty", entropy).orderBy(F.desc("uncertainty"), key).limit(n)
