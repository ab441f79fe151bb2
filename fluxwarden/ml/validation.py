"""Checks before and after training: a report of eight, a grid search behind a recall gate, an ablation of feature sets.

A trainer takes rows and gives a scorer; a scorer gives rows with ``probability`` (of a threat) and ``prediction`` (a class). Every check is passes over the whole table;
what comes to the driver is one row of figures each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import written
from . import metrics
from .boosting import SoftmaxBoosting

Scorer = Callable[[DataFrame], DataFrame]
Trainer = Callable[[DataFrame], Scorer]
#: Limits of the checks, columns that identify a row, what a chosen model must recall and be precise in where it is unknown data.
MAX_ADVERSARIAL_AUC, MAX_ZEROS, MAX_CORRELATION, MAX_RATIO, MAX_GAP, MIN_F1, MAX_BRIER, MIN_TREND, MAX_DROP = 0.6, 0.9, 0.95, 100, 0.10, 0.7, 0.15, -0.02, 0.20
IDENTIFIERS = ("flow_id", "timestamp", "dataset_source")
MIN_RECALL = 0.65
CHECKS = ("leakage", "distributions", "balance", "learning_curve", "calibration", "temporal", "cross_dataset", "importance")


def boosted(features: list[str], label: str, classes: int = 2, weight: str | None = None, **how) -> Trainer:
    """A trainer of ``SoftmaxBoosting``; a threat is any class but 0."""

    def train(df: DataFrame) -> Scorer:
        model = SoftmaxBoosting(**({"rounds": 8, "depth": 3, "rate": 0.3, "bins": 32} | how)).fit(df, features, label, classes, weight)

        def score(rows: DataFrame) -> DataFrame:
            p = model.transform(rows, "_p")
            return p.withColumn("probability", 1 - F.col("_p")[0]).withColumn("prediction", F.expr("cast(array_position(_p, array_max(_p)) - 1 as int)")).drop("_p")

        return score

    return train


def macro_f1(scored: DataFrame, label: str) -> float:
    return metrics.by_class(scored, label, "prediction").agg(F.avg("f1")).first()[0] or 0.0


def _fold(key: str, folds: int):
    return F.pmod(F.xxhash64(key), F.lit(folds))


def _part(df: DataFrame, order: str, parts: int) -> DataFrame:
    """``df`` plus part, which of so many stretches of ``order`` of about equal size a row is in."""
    marks = df.agg(F.percentile_approx(F.col(order).cast("double"), F.array(*[F.lit(k / parts) for k in range(1, parts)])).alias("m")).first()["m"] or []
    part = F.lit(0)
    for m in marks:
        part = part + F.when(F.col(order).cast("double") > m, 1).otherwise(0)
    return df.withColumn("part", part)


class Validator:
    """The eight checks of one table. ``order`` is a column that rises with time, ``key`` tells rows apart."""

    def __init__(self, df: DataFrame, features: list[str], label: str, key: str, order: str, trainer: Trainer | None = None, folds: int = 5):
        self.df, self.features, self.label, self.key, self.order, self.folds = written(df, "validated"), features, label, key, order, folds
        self.trainer = trainer or boosted(features, label)
        self.rows: list[tuple[str, float | None, bool, str]] = []

    def _say(self, check: str, value: float | None, failed: bool, note: str = "") -> float | None:
        self.rows.append((check, None if value is None else float(value), bool(failed), note))
        return value

    def leakage(self) -> float:
        """Whether a model can tell the last fifth of the time from the rest, by cross-validated AUC."""
        d = _part(self.df, self.order, 5).withColumn("_late", (F.col("part") == 4).cast("int")).withColumn("_fold", _fold(self.key, self.folds))
        train = boosted(self.features, "_late")
        scored = None
        for k in range(self.folds):
            s = train(d.where(F.col("_fold") != k))(d.where(F.col("_fold") == k)).select("_late", "probability")
            scored = s if scored is None else scored.unionByName(s)
        auc = metrics.roc_auc(scored, "_late", "probability").first()["auc"] or 0.5
        return self._say("leakage", auc, auc > MAX_ADVERSARIAL_AUC, "the last fifth can be told from the rest" if auc > MAX_ADVERSARIAL_AUC else "")

    def distributions(self) -> float:
        """Features without spread, of zeros, or that are the label: how many."""
        x, y = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features}, F.col(self.label).cast("double")
        row = self.df.agg(F.count("*").alias("n"), *[e.alias(f"{f}|{k}") for f, c in x.items() for k, e in (("s", F.stddev_pop(c)), ("z", F.avg((c == 0).cast("double"))), ("r", F.try_divide(F.covar_pop(c, y), F.stddev_pop(c) * F.stddev_pop(y))))]).first()
        notes = []
        for f in self.features:
            if (row[f"{f}|s"] or 0.0) < 1e-6:
                notes.append(f"{f}: no spread")
            if (row[f"{f}|z"] or 0.0) > MAX_ZEROS:
                notes.append(f"{f}: {row[f'{f}|z']:.1%} zeros")
            if abs(row[f"{f}|r"] or 0.0) > MAX_CORRELATION and row["n"] >= 8:  # fewer rows don't make such a correlation sure (p under 0.001)
                notes.append(f"{f}: correlation with the label {row[f'{f}|r']:.3f}")
        return self._say("distributions", len(notes), bool(notes), "; ".join(notes))

    def balance(self) -> float:
        """How many times the rarest class fits into the most frequent."""
        n = [r["n"] for r in self.df.groupBy(self.label).agg(F.count("*").alias("n")).collect()]
        ratio = max(n) / min(n) if n else 1.0
        return self._say("balance", ratio, ratio > MAX_RATIO, f"{ratio:.0f}:1" if ratio > MAX_RATIO else "")

    def learning_curve(self, shares: tuple[float, ...] = (0.1, 0.4, 1.0)) -> list[tuple[float, float, float]]:
        """Macro F1 of training rows and of folds of time that were left out, for growing shares of the training rows; the last gap is judged."""
        d = _part(self.df, self.order, self.folds)
        curve = []
        for share in shares:
            own = d.where(F.pmod(F.xxhash64(self.key, F.lit("curve")), F.lit(1000)) < F.lit(round(share * 1000)))
            pairs = []
            for k in range(self.folds):
                kept = own.where(F.col("part") != k)
                score = self.trainer(kept)
                pairs.append((macro_f1(score(kept), self.label), macro_f1(score(d.where(F.col("part") == k)), self.label)))
            curve.append((share, sum(p[0] for p in pairs) / len(pairs), sum(p[1] for p in pairs) / len(pairs)))
        gap, f1 = curve[-1][1] - curve[-1][2], curve[-1][2]
        self._say("learning_curve", gap, gap > MAX_GAP or f1 < MIN_F1, f"overfits by {gap:.3f}" if gap > MAX_GAP else f"F1 only {f1:.3f}" if f1 < MIN_F1 else "")
        return curve

    def calibration(self, score: Scorer, rows: DataFrame) -> float:
        """Brier score of the probability of a threat."""
        y = (F.col(self.label) > 0).cast("double")
        brier = score(rows).agg(F.avg((F.col("probability") - y) * (F.col("probability") - y))).first()[0]
        return self._say("calibration", brier, (brier or 0.0) > MAX_BRIER, f"Brier score {brier:.3f}" if (brier or 0.0) > MAX_BRIER else "")

    def temporal(self, score: Scorer, parts: int = 10) -> float | None:
        """Slope of the macro F1 over stretches of time that hold several classes."""
        scored = score(_part(self.df, self.order, parts)).select("part", self.label, "prediction")
        cells = {}
        for r in scored.groupBy("part", self.label, "prediction").agg(F.count("*").alias("n")).collect():
            cells.setdefault(r["part"], []).append((r[self.label], r["prediction"], r["n"]))
        f1 = []
        for _, c in sorted(cells.items()):
            if len({y for y, _, _ in c}) > 1:
                each = [2 * sum(n for y, p, n in c if y == p == k) / max(1, sum(n * ((y == k) + (p == k)) for y, p, n in c)) for k in {x for y, p, _ in c for x in (y, p)}]
                f1.append(sum(each) / len(each))
        if len(f1) <= 2:
            return self._say("temporal", None, False, "too few stretches")
        mean = (len(f1) - 1) / 2
        slope = sum((k - mean) * v for k, v in enumerate(f1)) / sum((k - mean) ** 2 for k in range(len(f1)))
        return self._say("temporal", slope, slope < MIN_TREND, f"F1 changes by {slope:.4f} a stretch" if slope < MIN_TREND else "")

    def cross_dataset(self, other: DataFrame) -> float:
        """What macro F1 is lost on another data set."""
        score = self.trainer(self.df)
        drop = macro_f1(score(self.df), self.label) - macro_f1(score(other), self.label)
        return self._say("cross_dataset", drop, drop > MAX_DROP, f"F1 is {drop:.3f} lower elsewhere" if drop > MAX_DROP else "")

    def importance(self, score: Scorer, identifiers: tuple[str, ...] = IDENTIFIERS) -> list[tuple[str, float]]:
        """What accuracy is lost when a feature's values are dealt to other rows; the most important feature may not identify rows."""
        right = lambda d: score(d).agg(F.avg((F.col("prediction") == F.col(self.label)).cast("double"))).first()[0] or 0.0
        mixed = written(self.df.repartition(F.xxhash64(self.key)).sortWithinPartitions(F.xxhash64(self.key, F.lit("mix"))), "mixed")
        whole = right(mixed)
        found = sorted(((f, whole - right(dealt(mixed, f))) for f in self.features), key=lambda r: (-r[1], r[0]))
        top = found[0][0] if found else ""
        self._say("importance", found[0][1] if found else None, top in identifiers, f"{top} identifies rows" if top in identifiers else top)
        return found

    def report(self, spark: SparkSession) -> DataFrame:
        """A row per check that was made: check, value, failed, note."""
        return spark.createDataFrame(self.rows, "check string, value double, failed boolean, note string")

    def all(self, other: DataFrame, held_out: DataFrame | None = None) -> DataFrame:
        """All eight; ``other`` is another data set, ``held_out`` rows to calibrate on (else the last fifth of the time, which the model doesn't see)."""
        d = _part(self.df, self.order, 5)
        score = self.trainer(d.where("part < 4"))
        self.leakage()
        self.distributions()
        self.balance()
        self.learning_curve()
        self.calibration(score, d.where("part = 4") if held_out is None else held_out)
        self.temporal(score)
        self.cross_dataset(other)
        self.importance(score)
        return self.report(self.df.sparkSession)


def dealt(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the values of a column dealt to other rows of the same batch: each row gets that of the row half a batch on. The rows should be mixed before."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            half = b.num_rows // 2
            places = pa.array([*range(half, b.num_rows), *range(half)], pa.int64())
            yield pa.RecordBatch.from_arrays([c.take(places) if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)

    return df.mapInArrow(run, df.schema)


def recall_and_precision(scored: DataFrame, label: str, threshold: float = 0.5) -> tuple[float, float]:
    called, threat = F.col("probability") >= threshold, F.col(label) > 0
    r = scored.agg(F.count_if(called & threat).alias("tp"), F.count_if(called).alias("called"), F.count_if(threat).alias("threats")).first()
    return r["tp"] / r["threats"] if r["threats"] else 0.0, r["tp"] / r["called"] if r["called"] else 0.0


def grid_search(train: DataFrame, unknown: DataFrame, trainers: dict[str, Callable[[], tuple[Trainer, DataFrame]] | Trainer], label: str, threshold: float = 0.5, min_recall: float = MIN_RECALL, fallback: Trainer | None = None, at_once: int = 3) -> tuple[str | None, Scorer, list[tuple[str, float, float]]]:
    """Fits every trainer on one prepared table, some at once, and chooses by what they recall of unknown data: at least ``min_recall``; of those in the order given, one replaces the
    best so far if it recalls more, or about as much (within 0.05) with more precision. Where none passes, ``fallback`` (else the one that recalls most)."""
    train, unknown = written(train, "grid"), written(unknown, "grid")

    def one(item) -> tuple[str, Scorer, float, float]:
        name, trainer = item
        score = trainer(train)
        return name, score, *recall_and_precision(score(unknown), label, threshold)

    with ThreadPoolExecutor(at_once) as pool:
        fitted = list(pool.map(one, trainers.items()))
    best = None
    for f in fitted:
        if f[2] >= min_recall and (best is None or f[2] > best[2] or abs(f[2] - best[2]) < 0.05 and f[3] > best[3]):
            best = f
    table = [(f[0], f[2], f[3]) for f in fitted]
    if best is None and fallback is not None:
        return None, fallback(train), table
    best = best or max(fitted, key=lambda f: f[2])
    return best[0], best[1], table


def ablation(train: DataFrame, unknown: DataFrame, feature_sets: dict[str, list[str]], makers: dict[str, Callable[[list[str]], Trainer]], label: str) -> DataFrame:
    """A row per model and feature set: recall, precision and f1 of threats in unknown data."""
    rows = []
    for model, make in makers.items():
        for name, features in feature_sets.items():
            r, p = recall_and_precision(make(features)(train)(unknown), label)
            rows.append((model, name, r, p, 2 * r * p / (r + p) if r + p else 0.0))
    return train.sparkSession.createDataFrame(rows, "model string, features string, recall double, precision double, f1 double")
