"""Row numbers and running sums over a whole table without one task that sees every row.

The first sort key is cut at approximate quantiles into as many ranges as there are shuffle partitions; each range is
numbered or summed in a task of its own, and what lies before it comes from a table with one row per range. Only quantiles go to
the driver. Rows with an equal first key stay in one range; keys that are null or NaN come last.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _ranged(df: DataFrame, key: Column, parts: int | None) -> DataFrame:
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("_key", key.cast("double"))
    marks: list[float] = []
    if n > 1:
        shares = F.array(*[F.lit(k / n) for k in range(1, n)])
        marks = df.where(F.col("_key").isNotNull() & ~F.isnan("_key")).agg(F.percentile_approx("_key", shares, F.lit(20 * n)).alias("m")).first()["m"] or []
    inner = sorted(set(marks) - {float("inf"), float("-inf")}) or [0.0]  # the transformer wants two ranges at least
    splits = [float("-inf"), *inner, float("inf")]
    return Bucketizer(splits=splits, inputCol="_key", outputCol="_range", handleInvalid="keep").transform(df).drop("_key")


def with_running_sums(df: DataFrame, key: Column, order: list, sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``df`` plus, for each name in ``sums``, the sum of its column up to and with the row, and the sum over all rows as name_total.
    ``key``: a number that sorts as ``order`` does, ties aside."""
    d = _ranged(df, key, parts)
    totals = d.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = totals.select(  # a row per range
        "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums], *[F.sum(f"_{n}").over(every).alias(f"{n}_total") for n in sums],
    )
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).join(F.broadcast(totals), "_range")
    return d.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


def with_row_number(df: DataFrame, key: Column, order: list, name: str = "_rn", parts: int | None = None) -> DataFrame:
    """``df`` plus each row's number from 1 in ``order``, and the number of rows as name_total."""
    return with_running_sums(df, key, order, {name: F.lit(1)}, parts)
