"""Model pipelines: preparation, score models, calibration, diverse sampling, isolation forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.common import finite


#: Values around a quantile's mark that are counted one by one in the last pass of ``quantiles``; how finely the sketches that lead there cut.
AROUND, FINE = 10_000, 10_000


def quantiles(df: DataFrame, features: list[str], shares: tuple[float, ...]) -> dict[str, list[float] | None]:
    """Exact quantiles (between two values, in proportion) of each feature; missing values don't count, and a feature without values has none. Sketches that add up
    bracket every mark, and each pass counts what lies below and between the brackets and cuts them finer, until few different values lie between; only these are
    counted one by one. No task holds more than a sketch and a bracket for each mark."""
    value = {c: finite(F.col(c).cast("double")) for c in features}
    sizes = df.agg(*[F.count(v).alias(c) for c, v in value.items()]).first()
    marks = {(c, k): p * (sizes[c] - 1) for c in features if sizes[c] for k, p in enumerate(shares)}
    low, high = dict.fromkeys(marks), dict.fromkeys(marks)
    below, between, open_ = dict.fromkeys(marks, 0), {m: sizes[m[0]] for m in marks}, list(marks)
    held = lambda m: value[m[0]].between(F.lit(low[m]), F.lit(high[m])) if low[m] is not None else value[m[0]].isNotNull()
    while open_ := [m for m in open_ if between[m] > AROUND]:
        cells = []
        for n, m in enumerate(open_):
            at = (marks[m] - below[m]) / max(1, between[m] - 1)
            ends = [min(1.0, max(0.0, at + d)) for d in (-3 / FINE, 3 / FINE)]
            cells.append(F.percentile_approx(F.when(held(m), value[m[0]]), F.array(*map(F.lit, ends)), F.lit(FINE)).alias(f"q{n}"))
        found = df.agg(*cells).first()
        was = {m: (low[m], high[m]) for m in open_}
        for n, m in enumerate(open_):
            low[m], high[m] = found[f"q{n}"]
        counted = df.agg(*[e.alias(f"{k}{n}") for n, m in enumerate(open_) for k, e in (("b", F.count_if(value[m[0]] < low[m])), ("i", F.count_if(held(m))))]).first()
        for n, m in enumerate(open_):
            below[m], between[m] = counted[f"b{n}"], counted[f"i{n}"]
            k = int(marks[m])
            if not below[m] <= k or not min(k + 1, sizes[m[0]] - 1) < below[m] + between[m]:  # the sketch missed the mark: the bracket before stands
                low[m], high[m] = was[m]
                below[m] = df.where(value[m[0]] < low[m]).count() if low[m] is not None else 0
        open_ = [m for m in open_ if (low[m], high[m]) != was[m] and low[m] != high[m]]  # many equal values: few different ones are left
    out: dict[str, list[float] | None] = {c: [0.0] * len(shares) if sizes[c] else None for c in features}
    each = [F.when(held(m), F.struct(F.lit(n).alias("m"), value[m[0]].alias("v"))) for n, m in enumerate(marks)]
    if each:
        counts: dict[int, list[tuple[float, int]]] = {}
        for r in df.select(F.explode(F.array_compact(F.array(*each))).alias("x")).groupBy("x.m", "x.v").agg(F.count("*").alias("n")).toLocalIterator():
            counts.setdefault(r["m"], []).append((r["v"], r["n"]))
        for n, (m, mark) in enumerate(marks.items()):
            out[m[0]][m[1]] = _at(sorted(counts[n]), mark - below[m])
    return out


def _at(counts: list[tuple[float, int]], mark: float) -> float:
    """The value at a place, from 0, among values with their numbers."""
    k, found, seen = int(mark), [], 0
    for v, n in counts:
        while len(found) < 2 and k + len(found) < seen + n:
            found.append(v)
        seen += n
    a, z = found[0], found[-1]
    return a if a == z or mark == k else (k + 1 - mark) * a + (mark - k) * z


def medians(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Median and interquartile range of each feature; missing values don't count."""
    found = quantiles(df, features, (0.25, 0.5, 0.75))
    return {c: (q[1], (q[2] - q[0]) or 1.0) if q else (0.0, 1.0) for c, q in found.items()}


def scaled(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Missing values become the median, then (x - median) / range."""
    return df.withColumns({c: (F.coalesce(finite(F.col(c).cast("double")), F.lit(m)) - m) / r for c, (m, r) in fitted.items()})


def standard(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each feature (1 where there is no spread); missing values don't count."""
    row = df.agg(*[f(finite(F.col(c).cast("double"))).alias(f"{c}_{k}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"{c}_m"] or 0.0, row[f"{c}_s"] or 1.0) for c in features}


def standardised(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Missing values become the mean, then (x - mean) / deviation."""
    return scaled(df, fitted)


def linear_reasons(df: DataFrame, weights: dict[str, float], means: dict[str, float], name: str = "reasons") -> DataFrame:
    """``df`` plus what each feature adds to a linear model's score, against its mean: exact for such models."""
    cells = [x for c, w in weights.items() for x in (F.lit(c), (F.col(c) - F.lit(float(means[c]))) * F.lit(float(w)))]
    return df.withColumn(name, F.create_map(*cells))


def meta_learner(df: DataFrame, label: str, c: float = 1.0):
    """Multinomial logistic regression over the scores of the single models, which ``assembled`` has put into features."""
    return LogisticRegression(labelCol=label, family="multinomial", weightCol="weight", regParam=1 / (c * max(1, df.count())), maxIter=100).fit(df)


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """``df`` plus a weight that gives every class the same mass."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    sizes = sizes.select(label, (F.sum("_n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("_n"))).alias("weight"))
    # A row per class: without the hint the join may deal all rows by class, half of the table to a task.
    return df.join(F.broadcast(sizes), label)


def stage_one(df: DataFrame, label: str, c: float = 0.1):
    """Balanced logistic regression; ``raw_score`` reads its decision value."""
    return LogisticRegression(labelCol=label, weightCol="weight", regParam=1 / (c * max(1, df.count())), maxIter=50).fit(df)


def raw_score(scored: DataFrame, name: str = "z") -> DataFrame:
    return scored.withColumn(name, F.get(vector_to_array("rawPrediction"), F.lit(1)))


def gbt(df: DataFrame, label: str, trees: int = 30, validation: str | None = None):
    model = GBTClassifier(labelCol=label, weightCol="weight", maxIter=trees, seed=7)
    return (model.setValidationIndicatorCol(validation) if validation else model).fit(df)


def forest(df: DataFrame, label: str, trees: int = 50):
    return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, seed=7).fit(df)


def calibrated(df: DataFrame, label: str, score: str):
    """Isotonic calibration of a score."""
    return IsotonicRegression(labelCol=label, featuresCol=score).fit(df)


def calibrated_by_folds(df: DataFrame, label: str, key: str, train, method: str = "isotonic", folds: int = 5):
    """Calibration by cross-validation: for each fold a model of the others (``train(rows)`` gives a function that adds column z) and, on the fold, a calibration of its score,
    isotonic or sigmoid. What is returned adds ``probability``, the mean over the folds."""
    fold = F.pmod(F.xxhash64(key), F.lit(folds))
    pairs = []
    for k in range(folds):
        score = train(df.where(fold != k))
        held = score(df.where(fold == k)).select(F.col(label).cast("double").alias("y"), "z")
        if method == "sigmoid":
            pairs.append((score, LogisticRegression(labelCol="y", maxIter=100).fit(VectorAssembler(inputCols=["z"], outputCol="features").transform(held))))
        else:
            pairs.append((score, IsotonicRegression(labelCol="y", featuresCol="z").fit(held)))

    def probability(rows: DataFrame) -> DataFrame:
        total, columns = F.lit(0.0), rows.columns
        for n, (score, model) in enumerate(pairs):
            d = score(rows)
            if method == "sigmoid":
                d = d.withColumn(f"_p{n}", 1 / (1 + F.exp(-(F.col("z") * F.lit(float(model.coefficients[0])) + F.lit(float(model.intercept))))))
            else:
                d = model.setPredictionCol(f"_p{n}").transform(d)
            columns = [*columns, f"_p{n}"]
            rows, total = d.select(*columns), total + F.col(f"_p{n}")
        return rows.withColumn("probability", total / len(pairs)).drop(*[f"_p{n}" for n in range(len(pairs))])

    return probability


#: Rows of a part that ``diverse`` clusters: its tasks read their part, as objects of 200 to 300 bytes a row, in each step.
PART_ROWS = 500_000


def diverse(df: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """For each of k clusters the row nearest to its centre. Beyond ``PART_ROWS`` rows they are dealt by key, so parts don't grow with the table, whatever its files."""
    rows = df.count()
    parts = df.select(key, "features").repartition(-(-rows // PART_ROWS), key) if rows > PART_ROWS else df
    model = KMeans(k=k, seed=seed).fit(parts)
    centres = [c.tolist() for c in model.clusterCenters()]
    centre = F.get(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("prediction"))
    d = F.aggregate(F.zip_with(vector_to_array("features"), centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return model.transform(df).withColumn("d", d).groupBy("prediction").agg(F.min_by(key, F.struct("d", key)).alias(key))


class IsolationForest:
    """Random splits over a bounded sample (``sample`` rows a tree, read once); anomaly is 2 ** -(depth / expected depth)."""

    def __init__(self, trees: int = 50, sample: int = 256, seed: int = 7):
        self.trees, self.sample, self.seed = trees, sample, seed

    def fit(self, df: DataFrame, features: list[str]) -> IsolationForest:
        self.features = features
        order = F.xxhash64(*features)
        rows = df.select(*[F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in features]).orderBy(order, *features).limit(self.sample * 4)
        x, rng = np.array(rows.collect(), float), np.random.default_rng(self.seed)
        self.forest = [self._grow(x[rng.choice(len(x), min(self.sample, len(x)), replace=False)], rng, 0) for _ in range(self.trees)] if len(x) else []
        return self

    def _grow(self, x: np.ndarray, rng, depth: int):
        if len(x) <= 1 or depth >= 8 or not (x.max(0) > x.min(0)).any():
            return depth + _expected(len(x))
        f = int(rng.choice(np.flatnonzero(x.max(0) > x.min(0))))
        cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
        left = x[:, f] < cut
        return f, cut, self._grow(x[left], rng, depth + 1), self._grow(x[~left], rng, depth + 1)

    def score(self, df: DataFrame, name: str = "anomaly") -> DataFrame:
        forest, usual = self.forest, _expected(self.sample)

        @F.pandas_udf("double")
        def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for page in pages:
                x = np.stack(page.to_numpy()) if len(page) else np.zeros((0, 1))
                depth = np.zeros(len(x))
                for tree in forest:
                    _walk(tree, x, np.arange(len(x)), depth)
                yield pd.Series(2.0 ** (-depth / max(1, len(forest)) / usual))

        return df.withColumn(name, run(F.array(*[F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in self.features])))


def _walk(tree, x: np.ndarray, rows: np.ndarray, depth: np.ndarray) -> None:
    if not isinstance(tree, tuple):
        depth[rows] += tree
    elif len(rows):
        f, cut, left, right = tree
        below = x[rows, f] < cut
        _walk(left, x, rows[below], depth)
        _walk(right, x, rows[~below], depth)


def _expected(n: int) -> float:
    """Mean depth of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0
