"""The exfiltration model of two stages: an isolation forest on benign rows, then a classifier of what is labelled.

Each tree of the forest is grown in a task of its own from its own rows: a row is dealt to trees by hashes of what it holds, and of a tree's rows those with the smallest
hashes are its sample. So every row of the table may be in a sample, whatever its size, no two trees share a pool, and a task holds one sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.common import finite
from ..operators import detectors
from .boosting import SoftmaxBoosting
from .models import _expected, _walk


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, most: int):
    if len(x) <= 1 or depth >= most or not (x.max(0) > x.min(0)).any():
        return depth + _expected(len(x))
    f = int(rng.choice(np.flatnonzero(x.max(0) > x.min(0))))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return f, cut, _grow(x[left], rng, depth + 1, most), _grow(x[~left], rng, depth + 1, most)


@dataclass
class SpreadIsolationForest:
    """``decision`` is negative for anomalies: the score of the ``contamination`` share of the rows that it was fitted on, taken from each row's score."""

    trees: int = 100
    sample: int = 256
    contamination: float = 0.01
    seed: int = 7
    forest: list = field(default_factory=list)
    offset: float = 0.5

    def _x(self):
        return F.array(*[F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in self.features])

    def fit(self, df: DataFrame, features: list[str], key: str) -> SpreadIsolationForest:
        """``key`` tells rows apart. Of an empty table there is no forest, and every row scores 0.5."""
        self.features, n = list(features), df.count()
        if not n:
            self.forest = []
            return self
        # As many trees for each row as fill twice the samples on average: all of them where the table is small.
        copies = min(self.trees, -(-2 * self.trees * self.sample // n))
        tree = lambda k: (F.pmod(F.xxhash64(key, F.lit(self.seed), k), F.lit(self.trees)) if copies < self.trees else k).cast("int")
        dealt = df.select(F.col(key).alias("key"), self._x().alias("x"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), tree))).alias("tree"))
        first = Window.partitionBy("tree").orderBy(F.xxhash64("key", "tree", F.lit(self.seed + 1)), "key")
        samples = dealt.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= self.sample)
        seed, most = self.seed, int(np.ceil(np.log2(max(2, self.sample))))

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            import pickle

            x = np.stack(pdf.sort_values("_n")["x"].to_numpy())
            return pd.DataFrame({"tree": [key[0]], "grown": [pickle.dumps(_grow(x, np.random.default_rng([seed, int(key[0])]), 0, most))]})

        import pickle

        grown = samples.select("tree", "x", "_n").groupBy("tree").applyInPandas(grow, "tree int, grown binary").collect()
        self.forest = [pickle.loads(bytes(r["grown"])) for r in sorted(grown, key=lambda r: r["tree"])]
        row = self.score(df).agg(F.percentile_approx("anomaly", F.lit(1 - self.contamination), F.lit(100_000)).alias("p")).first()
        self.offset = row["p"]
        return self

    def score(self, df: DataFrame, name: str = "anomaly") -> DataFrame:
        forest, usual = self.forest, _expected(self.sample)

        @F.pandas_udf("double")
        def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for page in pages:
                x = np.stack(page.to_numpy()) if len(page) else np.zeros((0, 1))
                depth = np.zeros(len(x))
                for tree in forest:
                    _walk(tree, x, np.arange(len(x)), depth)
                yield pd.Series(2.0 ** (-depth / max(1, len(forest)) / usual) if forest else np.full(len(x), 0.5))

        return df.withColumn(name, run(self._x()))

    def decision(self, df: DataFrame, name: str = "decision") -> DataFrame:
        return self.score(df, "_anomaly").withColumn(name, F.lit(self.offset) - F.col("_anomaly")).drop("_anomaly")


class ExfilModel:
    """Both stages. Without ``fit_supervised`` the first decides alone."""

    def __init__(self, features: list[str], key: str, trees: int = 100, **how):
        self.features, self.key = features, key
        self.first = SpreadIsolationForest(trees, **how)
        self.second: SoftmaxBoosting | None = None

    def fit_unsupervised(self, benign: DataFrame) -> ExfilModel:
        self.first.fit(benign, self.features, self.key)
        return self

    def fit_supervised(self, labelled: DataFrame, label: str, only_anomalous: bool = False, **how) -> ExfilModel:
        """``label``: 1 is exfiltration. ``only_anomalous`` trains on the rows that the first stage would pass on."""
        rows = self.first.decision(labelled).where("decision < 0").drop("decision") if only_anomalous else labelled
        self.second = SoftmaxBoosting(**({"rounds": 20, "depth": 4, "rate": 0.1} | how)).fit(rows, self.features, label, 2)
        return self

    def predict(self, df: DataFrame, bytes_ratio, name: str = "exfil") -> DataFrame:
        """``df`` plus struct(anomaly_score, exfil_probability, prediction, trigger); ``bytes_ratio``: a column, bytes out to bytes in."""
        d = self.first.decision(df, "_decision")
        p = None
        if self.second is not None:
            d = self.second.transform(d, "_p")
            p = F.col("_p")[1]
        return d.withColumn(name, detectors.exfil_predict(F.col("_decision"), p, bytes_ratio)).drop("_decision", "_p")
