"""Evaluation as aggregates: confusion, precision and recall, ranking curves, calibration, drift, federated averages."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import order, state

#: What a model must reach to be promoted.
PROMOTION = {"macro_f1": 0.95, "c2_recall": 0.97, "dns_recall": 0.98, "exfil_recall": 0.96, "max_fp_rate": 0.003}


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def by_class(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class, 0 where undefined."""
    c = confusion(df, label, predicted)
    cells = c.select(F.explode(F.array(F.struct(F.col("label").alias("cls"), F.lit("l").alias("side")), F.struct(F.col("predicted").alias("cls"), F.lit("p").alias("side")))).alias("x"), "n", (F.col("label") == F.col("predicted")).alias("hit"))
    g = cells.groupBy(F.col("x.cls").alias("cls")).agg(
        F.sum(F.when((F.col("x.side") == "l") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("x.side") == "l", F.col("n")).otherwise(0)).alias("actual"),
        F.sum(F.when(F.col("x.side") == "p", F.col("n")).otherwise(0)).alias("called"),
    )
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = safe(F.col("tp"), F.col("called")), safe(F.col("tp"), F.col("actual"))
    return g.select("cls", "tp", "actual", "called", p.alias("precision"), r.alias("recall"), safe(2 * p * r, p + r).alias("f1"))


def kappa(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """accuracy, kappa in one row."""
    g = by_class(df, label, predicted).agg(F.sum("tp").alias("tp"), F.sum("actual").alias("n"), F.sum(F.col("actual") * F.col("called")).alias("chance"))
    po, pe = F.col("tp") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return g.select(po.alias("accuracy"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(0.0)).alias("kappa"))


def curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """A row per distinct score: true and false positives at that threshold, and all positives and negatives. Equal scores are added up
    first; the running sums are made range by range."""
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    return order.with_running_sums(per, -F.col("threshold"), [F.desc("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")})


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """auc; null where one of the classes is missing."""
    c = curve(df, label, score)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return c.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def precision_recall(df: DataFrame, label: str, score: str) -> DataFrame:
    c = curve(df, label, score)
    return c.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("tp_total")).alias("recall"))


def precision_floor(df: DataFrame, label: str, score: str, floor: float = 0.60) -> DataFrame:
    """The lowest threshold from which on precision reaches the floor; else the threshold of the highest precision."""
    pr = precision_recall(df, label, score)
    return pr.agg(F.coalesce(F.min(F.when(F.col("precision") >= floor, F.col("threshold"))), F.max_by("threshold", F.struct("precision", "threshold"))).alias("threshold"))


def evaluation_report(df: DataFrame, label: str, predicted: str, score: str | None = None) -> DataFrame:
    """One table of an evaluation, (metric, cls, value): accuracy, kappa and macro and weighted F1, precision, recall, F1 and support of each class, the confusion matrix
    (metric says predicted, cls the label), and with ``score``, the chance of a class other than 0, the areas under the ROC and the precision-recall curve and the Brier score."""
    row = lambda metric, value, cls=F.lit(None): F.struct(F.lit(metric).alias("metric") if isinstance(metric, str) else metric.alias("metric"), cls.cast("string").alias("cls"), value.cast("double").alias("value"))
    c, k = F.col, F.col("cls")
    each = by_class(df, label, predicted)
    cells = each.select(F.explode(F.array(*[row(m, c(m), k) for m in ("precision", "recall", "f1")], row("support", c("actual"), k))).alias("r"))
    whole = each.agg(F.avg("f1").alias("macro"), F.try_divide(F.sum(c("f1") * c("actual")), F.sum("actual")).alias("weighted")).select(F.explode(F.array(row("macro_f1", c("macro")), row("weighted_f1", c("weighted")))).alias("r"))
    agreed = kappa(df, label, predicted).select(F.explode(F.array(row("accuracy", c("accuracy")), row("kappa", c("kappa")))).alias("r"))
    matrix = confusion(df, label, predicted).select(row(F.concat(F.lit("predicted_"), c("predicted").cast("string")), c("n"), c("label")).alias("r"))
    out = cells.unionByName(whole).unionByName(agreed).unionByName(matrix)
    if score is not None:
        binary = df.select((F.col(label) > 0).cast("int").alias("y"), F.col(score).alias("s"))
        steps = curve(binary, "y", "s").select(F.try_divide(c("pos"), c("tp_total")).alias("step"), (c("tp") / (c("tp") + c("fp"))).alias("p"))
        for d in (roc_auc(binary, "y", "s").select(row("roc_auc", c("auc")).alias("r")), steps.agg(F.sum(c("step") * c("p")).alias("v")).select(row("average_precision", c("v")).alias("r")), brier(binary, "y", "s").select(row("brier", c("brier")).alias("r"))):
            out = out.unionByName(d)
    return out.select("r.*")


def brier(df: DataFrame, label: str, p: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(p) - F.col(label), F.lit(2.0))).alias("brier"))


def sweep(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold of a short grid, in one pass."""
    marked = df.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col(score) >= t).alias("hit")) for t in thresholds])).alias("x"))
    g = marked.groupBy(F.col("x.threshold").alias("threshold")).agg(F.count_if(F.col("x.hit") & (F.col("y") == 1)).alias("tp"), F.count_if(F.col("x.hit") & (F.col("y") != 1)).alias("fp"), F.count_if(~F.col("x.hit") & (F.col("y") == 1)).alias("fn"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return g.select("threshold", safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), safe(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def ks_two_sample(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Largest difference of the empirical distributions, sizes, and the asymptotic p-value."""
    both = a.select(F.col(value).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(F.col(value).alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = both.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cum = order.with_running_sums(per, F.col("x"), ["x"], {"ca": F.col("a"), "cb": F.col("b")}).withColumnsRenamed({"ca_total": "na", "cb_total": "nb"})
    d = cum.agg(F.max(F.abs(F.try_divide(F.col("ca"), F.col("na")) - F.try_divide(F.col("cb"), F.col("nb")))).alias("d"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))
    lam = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))) * F.col("d")
    p = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * F.pow(k.cast("double"), F.lit(2.0)) * lam * lam))
    # Near 0 the series alternates without end; its limit is 1.
    return d.select("d", "n_a", "n_b", F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).alias("p"))


def fed_avg(updates: DataFrame, key: str, weight: str, n: str) -> DataFrame:
    return updates.groupBy(key).agg((F.sum(F.col(weight) * F.col(n)) / F.sum(n)).alias(weight))


def separation(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """feature, mean of class 0 and 1, and their difference."""
    y = F.col(label)
    row = df.agg(*[F.avg(F.when(y == k, F.col(c))).alias(f"{c}_{k}") for c in features for k in (0, 1)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_0").alias("mean_0"), F.col(f"{c}_1").alias("mean_1")) for c in features])
    return row.select(F.explode(cells).alias("x")).select("x.*", (F.col("x.mean_1") - F.col("x.mean_0")).alias("difference"))


def promotion(metrics: dict[str, float], in_use: dict[str, float] | None = None, gates: dict[str, float] | None = None) -> list[str]:
    """Why a model may not be promoted: gates (at least, or at most for names that begin with max_) that it misses or that aren't measured, and a
    macro F1 that doesn't beat the one in use. An empty list lets it pass."""
    out = []
    for name, bound in (PROMOTION if gates is None else gates).items():
        value = metrics.get(name.removeprefix("max_"))
        if value is None or math.isnan(value) or (value > bound if name.startswith("max_") else value < bound):
            out.append(name)
    if in_use is not None and not metrics.get("macro_f1", 0.0) > in_use.get("macro_f1", 0.0):
        out.append("not better than the model in use")
    return out


def too_good(accuracy: float, kappa_: float) -> bool:
    """A model that only repeats the largest class: nearly all right, yet no better than chance."""
    return accuracy > 0.999 and kappa_ < 0.1


def noise_robust(clean_f1: float, noisy_f1: float, most: float = 0.05) -> bool:
    return clean_f1 > 0 and (clean_f1 - noisy_f1) / clean_f1 < most


def with_noise(df: DataFrame, features: list[str], sigma: float = 0.1, seed: int = 7, key: str | None = None) -> DataFrame:
    """Features with normal noise of ``sigma`` of their own spread; the spread is measured on all rows. The noise comes from hashes of the row (of ``key``, else of
    all its columns) by Box and Muller's way, so it doesn't depend on how rows are dealt."""
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in features]).first()
    row = F.xxhash64(*([key] if key else df.columns))
    even = lambda i, k: (F.pmod(F.xxhash64(row, F.lit(seed), F.lit(i), F.lit(k)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    normal = lambda i: F.sqrt(F.lit(-2.0) * F.log(even(i, 1))) * F.cos(F.lit(2 * math.pi) * even(i, 2))
    return df.withColumns({c: F.col(c) + normal(i) * F.lit(float(sigma * (spread[c] or 0.0))) for i, c in enumerate(features)})


def drift(a: DataFrame, b: DataFrame, features: list[str], p: float = 0.01, share: float = 0.20, least: int = 30) -> DataFrame:
    """feature, d, p, drifted, and whether more than ``share`` of all features have drifted; under ``least`` rows on a side nothing drifts."""
    out = None
    for f in features:
        one = ks_two_sample(a, b, f).select(F.lit(f).alias("feature"), "d", "p", ((F.col("p") < p) & (F.col("n_a") >= least) & (F.col("n_b") >= least)).alias("drifted"))
        out = one if out is None else out.unionByName(one)
    every = Window.partitionBy()  # a row per feature
    return out.withColumn("alarm", F.avg(F.col("drifted").cast("int")).over(every) > share)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation; 0 where a side has no spread, which ``corr`` takes for a division by zero."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))), F.lit(0.0))


def prequential(df: DataFrame, chunk: str, label: str, predicted: str, classes: list) -> DataFrame:
    """chunk, n, accuracy, macro_f1, kappa over all rows up to and with each chunk (a number that grows with time), for rows predicted before they are
    learned from. Cells are counted per chunk first; only chunks are put in order."""
    cell = lambda a, b: F.count_if((F.col(label) == a) & (F.col(predicted) == b))
    at = {(i, j): f"c{i}_{j}" for i in range(len(classes)) for j in range(len(classes))}
    per = df.groupBy(chunk).agg(*[cell(classes[i], classes[j]).alias(n) for (i, j), n in at.items()])
    d = order.with_running_sums(per.withColumnsRenamed({n: f"of_{n}" for n in at.values()}), F.col(chunk), [chunk], {n: F.col(f"of_{n}") for n in at.values()})
    k = range(len(classes))
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    n, hit = add(F.col(c) for c in at.values()), add(F.col(at[i, i]) for i in k)
    actual, called = [add(F.col(at[i, j]) for j in k) for i in k], [add(F.col(at[j, i]) for j in k) for i in k]
    f1 = add(F.when(actual[i] + called[i] > 0, 2 * F.col(at[i, i]) / (actual[i] + called[i])).otherwise(0.0) for i in k) / len(classes)
    chance = add(actual[i] * called[i] for i in k) / (n * n)
    agree = hit / n
    kap = F.when(chance < 1, F.try_divide(agree - chance, 1 - chance)).otherwise(0.0)
    return d.where(n > 0).select(chunk, n.alias("n"), agree.alias("accuracy"), f1.alias("macro_f1"), kap.alias("kappa"))


def counter_rate(samples: DataFrame, keys: list[str], ts: str, counter: str, width_s: int = 60) -> DataFrame:
    """keys, bucket, per_second: how fast a counter rises between the first and last sample of each window; null where a window has one sample. A counter
    that has been set back counts from 0."""
    d = samples.withColumn("_b", state.bucket(F.col(ts), width_s)).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    w = Window.partitionBy(*keys, "_b").orderBy("_us", counter)
    step = F.col(counter) - F.lag(counter).over(w)
    d = d.withColumn("_step", F.when(step < 0, F.col(counter)).otherwise(step))
    g = d.groupBy(*keys, F.col("_b").alias("bucket")).agg(F.sum("_step").alias("_rise"), ((F.max("_us") - F.min("_us")) / F.lit(1e6)).alias("_s"))
    return g.select(*keys, "bucket", F.try_divide(F.col("_rise").cast("double"), F.col("_s")).alias("per_second"))


def histogram_quantile(cumulative: DataFrame, q: float, keys: list[str] = (), le: str = "le", n: str = "n") -> DataFrame:
    """keys, quantile: from counts of values up to each bound, between bounds by a straight line (from 0 below the first); values past the last bound
    have that bound. A row per bound comes in."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(le)
    d = cumulative.withColumn("_all", F.max(n).over(Window.partitionBy(*(keys or [F.lit(1)])))).withColumn("_below", F.coalesce(F.lag(n).over(w), F.lit(0))).withColumn("_from", F.coalesce(F.lag(le).over(w), F.lit(0.0)))
    rank = F.col("_all") * q
    at = F.col("_from") + (F.col(le) - F.col("_from")) * F.try_divide(rank - F.col("_below"), F.col(n) - F.col("_below"))
    hit = (F.col(n) >= rank) & (F.col("_below") < rank)
    return d.groupBy(*keys).agg(F.min(F.when(hit, at)).alias("quantile"))
