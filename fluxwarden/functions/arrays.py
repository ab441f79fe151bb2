"""Statistics of number arrays (inter-arrival times, sizes) as column expressions; arrays hold doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bind

#: Intervals in seconds of known beacons, in the order in which they are tried.
KNOWN_INTERVALS = (60, 300, 3600, 30, 120, 10)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def moment(a: Column, k: int) -> Column:
    """k-th central moment."""
    return bind(mean(a), lambda m: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.pow(x - m, F.lit(float(k)))) / F.size(a)))


def std(a: Column) -> Column:
    return F.sqrt(moment(a, 2))


def cv(a: Column) -> Column:
    """Standard deviation over mean; 0 unless the mean is positive."""
    return bind(mean(a), lambda m: F.when(m > 0, std(a) / m).otherwise(F.lit(0.0)))


def cv_eps(a: Column) -> Column:
    return bind(mean(a), lambda m: std(a) / (F.abs(m) + 1e-9))


def median(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(a)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def skewness(a: Column) -> Column:
    """Biased; 0 under four values or without spread."""
    return bind(moment(a, 2), lambda v: F.when((F.size(a) >= 4) & (v > 0), moment(a, 3) / F.pow(v, F.lit(1.5))).otherwise(F.lit(0.0)))


def kurtosis(a: Column) -> Column:
    """Excess, biased; 0 under four values or without spread."""
    return bind(moment(a, 2), lambda v: F.when((F.size(a) >= 4) & (v > 0), moment(a, 4) / (v * v) - 3).otherwise(F.lit(0.0)))


def diffs(a: Column) -> Column:
    """Differences of neighbours."""
    return F.when(F.size(a) >= 2, F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.get(a, i) - F.get(a, i - 1))).otherwise(F.array().cast("array<double>"))


def share_where(a: Column, test) -> Column:
    return F.when(F.size(a) > 0, F.size(F.filter(a, test)) / F.size(a)).otherwise(F.lit(0.0))


def small_ratio(sizes: Column) -> Column:
    return share_where(sizes, lambda x: x < 100)


def large_ratio(sizes: Column) -> Column:
    return share_where(sizes, lambda x: x > 1400)


def burst_ratio(iats_ms: Column) -> Column:
    return share_where(iats_ms, lambda x: x < 10)


def silence_ratio(iats_ms: Column) -> Column:
    return share_where(iats_ms, lambda x: x > 10_000)


def regularity(cv_: Column) -> Column:
    return 1 - F.least(F.lit(1.0), cv_)


def context_regularity(cv_: Column) -> Column:
    return 1 - F.least(F.lit(1.0), cv_ / 2)


def histogram_entropy(sizes: Column, bins: int = 16, top: float = 1500.0) -> Column:
    """Entropy of shares in equal bins over [0, top], its right edge included; values outside don't count."""
    inside = F.filter(sizes, lambda x: (x >= 0) & (x <= top))
    slots = F.transform(inside, lambda x: F.least(F.floor(x / (top / bins)), F.lit(bins - 1)))

    def of(s: Column) -> Column:
        share = F.transform(F.array_distinct(s), lambda b: F.size(F.filter(s, lambda y: y == b)) / F.size(s))
        return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p + 1e-9))

    return F.coalesce(bind(slots, of), F.lit(0.0))


def acf(a: Column, lag: Column) -> Column:
    """Autocorrelation at a lag, of the centred series over its own square sum."""

    def of(c: Column) -> Column:
        power = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x * x)
        pairs = F.transform(F.sequence(lag, F.size(c) - 1), lambda i: F.get(c, i) * F.get(c, i - lag))
        return F.when(power > 0, total(pairs) / power)

    return bind(bind(mean(a), lambda m: F.transform(a, lambda x: x - m)), of)


def periodicity(a: Column, least: int = 10) -> Column:
    """struct(score, period): the largest autocorrelation over lags from 1 (the first of equals), not under 0, and mean times
    its lag; 0 and 0 for short or constant series."""
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("period"))

    def of(series: Column) -> Column:
        lags = F.transform(F.sequence(F.lit(1), F.greatest(F.size(series) - 1, F.lit(1))), lambda k: F.struct(acf(series, k).alias("r"), (-k).alias("k")))
        best = F.array_max(F.filter(lags, lambda x: x["r"].isNotNull()))
        return bind(best, lambda b: F.when(b.isNotNull(), F.struct(F.greatest(F.lit(0.0), b["r"]).alias("score"), (mean(series) * -b["k"]).alias("period"))).otherwise(none))

    return F.when(F.size(a) >= least, bind(a, of)).otherwise(none)


def top_lags(a: Column, k: int = 5) -> Column:
    """(lag, score) of the k lags with the largest autocorrelation, the larger lag of equals first; empty for a constant series."""

    def of(series: Column) -> Column:
        lags = F.transform(F.sequence(F.lit(1), F.greatest(F.size(series) - 1, F.lit(1))), lambda i: F.struct(acf(series, i).alias("score"), i.alias("lag")))
        best = F.sort_array(F.filter(lags, lambda x: x["score"].isNotNull()), False)
        return F.slice(F.transform(best, lambda x: F.struct(x["lag"], x["score"])), 1, k)

    return bind(a, of)


def known_interval(period_s: Column, tolerance: float = 0.35) -> Column:
    """The first known interval within the tolerance of the period, else null."""
    known = F.array(*[F.lit(k) for k in KNOWN_INTERVALS])
    return F.get(F.filter(known, lambda k: F.abs(period_s - k) / k < tolerance), F.lit(0))


def pad(a: Column, n: int, filler: Column) -> Column:
    """Cut or filled to n elements."""
    return F.slice(F.concat(a, F.array_repeat(filler, n)), 1, n)


def top_k(a: Column, k: int = 5) -> Column:
    """(value, place) of the k largest, the first place of equals first."""
    return F.slice(F.transform(F.sort_array(F.transform(a, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))), lambda s: F.struct((-s["v"]).alias("value"), s["i"].alias("place"))), 1, k)


def prediction_entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc - x * F.log(x + 1e-9))


def index_correlation(a: Column) -> Column:
    """Correlation of the values with their places; 0 for a series without spread or of one value."""

    def of(x: Column) -> Column:
        n, m = F.size(x), mean(x)
        spread = total(F.transform(x, lambda v: (v - m) * (v - m)))
        shared = total(F.transform(x, lambda v, i: (v - m) * (i - (n - 1) / 2)))
        places = n * (n * n - 1) / F.lit(12.0)
        flat = F.sqrt(spread / n) <= F.lit(1e-9) * (F.abs(m) + 1)
        return F.when((n < 2) | flat, F.lit(0.0)).otherwise(shared / F.sqrt(spread * places))

    return bind(a, of)


CONTEXT = ("iat_cv", "trend", "duration_cv", "history_len", "periodicity_score", "regularity", "dominant_period_ms")


def _grid(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lists as rows of one array, filled up with zeros, and their sizes; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out, sizes


def _sums(a: np.ndarray) -> np.ndarray:
    """Sum of each row, added from left to right as SQL adds."""
    out = np.zeros(len(a))
    for column in a.T:
        out += column
    return out


def _context(times: np.ndarray, n: np.ndarray, durations: np.ndarray, n_durations: np.ndarray) -> dict[str, np.ndarray]:
    """``CONTEXT`` of each row; of rows under two times it means nothing."""
    size = np.maximum(n - 1, 1)  # intervals
    real = np.arange(max(times.shape[1] - 1, 1)) < (n - 1)[:, None]
    x = np.where(real, np.diff(times, axis=1) / 1e6 if times.shape[1] > 1 else 0.0, 0.0)
    m = _sums(x) / size
    off = np.where(real, x - m[:, None], 0.0)
    spread = _sums(off * off)
    s = np.sqrt(spread / size)
    z = off / (s + 1e-9)[:, None]
    power = _sums(z * z)
    best, lag = np.full(len(x), -np.inf), np.zeros(len(x))
    for k in range(1, x.shape[1]):  # the correlation at a lag is that of the series divided by its spread, up to the guards against zero
        r = np.where(k < n - 1, _sums(z[:, k:] * z[:, :-k]) / (power + 1e-9), -np.inf)
        lag[r > best] = k
        best = np.maximum(best, r)
    iat_cv = s / (m + 1e-9)
    shared = _sums(off * (np.arange(x.shape[1]) - (size[:, None] - 1) / 2))
    flat = (size < 2) | (s <= 1e-9 * (np.abs(m) + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        trend = np.where(flat, 0.0, shared / np.sqrt(spread * (size * (size * size - 1.0) / 12.0)))
        mean = _sums(durations) / n_durations
        held = np.arange(durations.shape[1]) < n_durations[:, None]
        duration_cv = np.sqrt(_sums(np.where(held, durations - mean[:, None], 0.0) ** 2) / n_durations) / (mean + 1e-9)
    short, even = size < 6, s < 1e-2
    score = np.where(short, 0.0, np.where(even, 1.0, best))
    period = np.where(short, 0.0, np.where(even, m * 1000.0, m * lag * 1000.0))
    return dict(zip(CONTEXT, (iat_cv, trend, duration_cv, n.astype(float), score, np.maximum(0.0, 1 - np.minimum(1.0, iat_cv / 2)), period), strict=True))


def host_context(times_us: Column, durations: Column) -> Column:
    """struct of ``CONTEXT`` from the flow times (microseconds, oldest first) and durations of a host's history: all 0 under two flows.
    Periodicity needs six intervals; a constant series has 1 at its own interval. Without durations, or where one is missing, duration_cv is null.
    Histories pass NumPy in Arrow batches: Spark interprets nested functions over arrays, at a millisecond a row."""

    @F.arrow_udf("struct<" + ", ".join(f"{c}: double" for c in CONTEXT) + ">")
    def run(times: pa.Array, lengths: pa.Array) -> pa.Array:
        (t, n), (d, k) = _grid(times), _grid(lengths)
        found = _context(t, n, d, k)
        none = n < 2
        columns = {c: np.where(none, 0.0, v) for c, v in found.items()}
        unknown = ~none & ((k == 0) | np.isnan(d).any(1))
        return pa.StructArray.from_arrays([pa.array(v, mask=unknown if c == "duration_cv" else None) for c, v in columns.items()], list(columns))

    return run(times_us, durations)


def norm_clip(v: Column, most: float) -> Column:
    """The vector scaled to a norm of ``most`` at most."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return bind(norm, lambda n: F.transform(v, lambda x: x * F.least(F.lit(1.0), F.lit(most) / (n + 1e-12))))


def noisy(v: Column, sigma: float, seed: int = 7) -> Column:
    """The vector with normal noise of ``sigma`` on each element, from hashes of its place, value and the seed (Box and Muller's way), so that a task run again
    gives the same."""
    even = lambda x, i, k: (F.pmod(F.xxhash64(x, i, F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return F.transform(v, lambda x, i: x + F.lit(sigma) * F.sqrt(F.lit(-2.0) * F.log(even(x, i, 1))) * F.cos(F.lit(2 * np.pi) * even(x, i, 2)))


@F.pandas_udf(T.DoubleType())
def fft_period(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Dominant period in seconds of packet counts: the arrival times (cumulated intervals) are read at 256 even places and the
    strongest frequency but zero is taken; 0 under 16 intervals."""
    for s in series:
        yield s.map(_fft_period).astype(float)


def _fft_period(intervals) -> float:
    if intervals is None or len(intervals) < 16:
        return 0.0
    times = np.cumsum(np.asarray(intervals, float))
    span = times[-1] - times[0]
    if not span > 0:
        return 0.0
    even = np.interp(np.linspace(times[0], times[-1], 256), times, np.asarray(intervals, float))
    power = np.abs(np.fft.rfft(even - even.mean()))
    k = int(np.argmax(power[1:])) + 1
    return float(span / k) if power[k] > 0 else 0.0


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("period", "height", "confidence")]))
def peak_period(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """First peak of the autocorrelation with a height of 0.2 and a prominence of 0.15 at least: period (mean times lag),
    height, and confidence (height times closeness to a known interval within 35 %); zeros under 8 intervals."""
    for s in series:
        yield pd.DataFrame([_peak(x) for x in s], columns=["period", "height", "confidence"])


def _peak(intervals) -> tuple[float, float, float]:
    if intervals is None or len(intervals) < 8:
        return 0.0, 0.0, 0.0
    x = np.asarray(intervals, float)
    c = x - x.mean()
    power = float(c @ c)
    if not power > 0:
        return 0.0, 0.0, 0.0
    r = np.correlate(c, c, "full")[len(c) - 1 :] / power
    for k in range(1, len(r) - 1):
        if r[k] > r[k - 1] and r[k] >= r[k + 1] and r[k] >= 0.2:
            higher_left = np.flatnonzero(r[:k] > r[k])
            higher_right = np.flatnonzero(r[k + 1 :] > r[k])
            left = r[(higher_left[-1] if len(higher_left) else 0) : k].min()
            right = r[k + 1 : k + 1 + (higher_right[0] + 1 if len(higher_right) else len(r))].min()
            if r[k] - max(left, right) >= 0.15:
                period = float(x.mean() * k)
                off = min(abs(period - i) / i for i in KNOWN_INTERVALS)
                return period, float(r[k]), float(r[k] * max(0.0, 1 - off / 0.35))
    return 0.0, 0.0, 0.0
