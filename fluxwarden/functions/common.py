"""Small column helpers: guarded ratios, missing values, binding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f) -> Column:
    """f(value) with ``value`` computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ratio_plus1(a: Column, b: Column) -> Column:
    return a / (b + 1)


def ratio_floor1(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def ratio_eps(a: Column, b: Column) -> Column:
    return a / (b + F.lit(1e-9))


def ratio_sentinel(a: Column, b: Column) -> Column:
    """a / b, or -1 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(-1.0))


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def zero_if_missing(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def iso_time(ts: Column) -> Column:
    """A time as ISO 8601 in UTC with microseconds."""
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
