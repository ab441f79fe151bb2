"""Softmax boosting of many classes on binned features, with an audit of what its gain rests on, and the buffer that it is trained anew from.

Features are cut at approximate quantiles into at most 255 bins, so a row is a few bytes. For each level of the trees of a round (one per class) every task adds the
gradients of its own rows up by node, feature and bin; the sums of tasks are added per node where they meet, and only they (nodes x features x bins) go to the
driver, which picks the splits. The scores of rows are kept beside the bins in a table that is written anew each round, so a lost executor costs no earlier round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import finite
from ..operators.storage import written

#: Rows at which the buffer is trained from, rows that it keeps after, and the share of the gain over which a feature may be a leak.
BUFFER_ROWS, KEPT_ROWS, MOST_GAIN = 200_000, 10_000, 0.40


@dataclass
class Tree:
    """A tree as arrays: the children of node i are 2i + 1 and 2i + 2; a feature of -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray, levels: int) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[at]))
        return at


@dataclass
class SoftmaxBoosting:
    rounds: int = 20
    depth: int = 4
    rate: float = 0.1
    bins: int = 64
    penalty: float = 1.0
    least: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[Tree]] = field(default_factory=list)
    gains: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, features: list[str], label: str, classes: int, weight: str | None = None) -> SoftmaxBoosting:
        """``label``: whole numbers from 0. Missing values fall into the first bin. Nothing is learned from an empty table."""
        self.features, self.classes, self.trees, self.gains = list(features), classes, [], dict.fromkeys(features, 0.0)
        shares = F.array(*[F.lit(k / self.bins) for k in range(1, self.bins)])
        row = df.agg(*[F.percentile_approx(finite(F.col(c).cast("double")), shares, F.lit(20 * self.bins)).alias(c) for c in features]).first()
        self.edges = [np.unique(np.array(row[c] or [0.0])) for c in features]
        state = written(self._binned(df, F.col(label).cast("int").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")), "boosting")
        for _ in range(self.rounds):
            grown = [self._empty() for _ in range(classes)]
            for level in range(self.depth):
                if not self._split(grown, level, self._sums(state, grown, level)):
                    break
            if all(t.feature[0] < 0 for t in grown):
                break
            self.trees.append(grown)
            state = written(self._scored(state, grown), "boosting")
        return self

    def _empty(self) -> Tree:
        n = (1 << self.depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def _matrix(self, column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.features))
        return np.stack([np.where(np.isnan(x[:, f]), 0, np.searchsorted(e, x[:, f])) for f, e in enumerate(self.edges)], 1).astype(np.uint8) if len(x) else np.zeros((0, len(self.features)), np.uint8)

    def _x(self):
        return F.array(*[F.coalesce(finite(F.col(c).cast("double")), F.lit(float("nan"))) for c in self.features]).alias("x")

    def _binned(self, df: DataFrame, *more) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = self._matrix(b.column(0))
                zero = pa.array([bytes(8 * self.classes)] * len(m), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in m], pa.binary()), b.column(1), b.column(2), zero], names=["bins", "y", "w", "scores"])

        return df.select(self._x(), *more).where("y is not null").mapInArrow(run, "bins binary, y int, w double, scores binary")

    @staticmethod
    def _held(b: pa.RecordBatch, features: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
        read = lambda c, kind, n: np.frombuffer(b"".join(c.to_pylist()), kind).reshape(-1, n)
        return read(b.column(0), np.uint8, features), read(b.column(3), np.float64, classes)

    def _sums(self, state: DataFrame, grown: list[Tree], level: int) -> dict[int, np.ndarray]:
        """For each class and node of the level (class << depth | place in the level): gradients and curvatures by feature and bin."""
        features, classes, bins, depth = len(self.features), self.classes, self.bins, self.depth
        first = (1 << level) - 1

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                m, scores = self._held(b, features, classes)
                y, w = b.column(1).to_numpy(), b.column(2).to_numpy()
                p = np.exp(scores - scores.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for k in range(classes):
                    at = grown[k].nodes(m, level) - first
                    g, h = w * (p[:, k] - (y == k)), w * np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16)
                    for node in np.unique(at[at >= 0]):
                        rows = np.flatnonzero(at == node)
                        held = out.setdefault(k << depth | int(node), np.zeros((features, bins, 2)))
                        for f in range(features):
                            held[f, :, 0] += np.bincount(m[rows, f], g[rows], bins)
                            held[f, :, 1] += np.bincount(m[rows, f], h[rows], bins)
            yield as_batch(out)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                for key, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    part = np.frombuffer(value.as_buffer(), np.float64).reshape(features, bins, 2)
                    out[key] = out[key] + part if key in out else part
            yield as_batch(out)

        def as_batch(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["node", "sums"])

        found = state.mapInArrow(add, "node int, sums binary").repartition("node").mapInArrow(meet, "node int, sums binary").collect()
        return {r["node"]: np.frombuffer(bytes(r["sums"]), np.float64).reshape(features, bins, 2) for r in found}

    def _split(self, grown: list[Tree], level: int, sums: dict[int, np.ndarray]) -> bool:
        """Splits the nodes of the level where that gains; tells whether any was split."""
        any_ = False
        worth = lambda g, h: g * g / (h + self.penalty)
        for key, s in sorted(sums.items()):
            tree, node = grown[key >> self.depth], (1 << level) - 1 + (key & (1 << self.depth) - 1)
            left = np.cumsum(s, 1)[:, :-1]
            whole = s[0].sum(0)
            right = whole - left
            gain = 0.5 * (worth(left[..., 0], left[..., 1]) + worth(right[..., 0], right[..., 1]) - worth(*whole))
            gain[(left[..., 1] < self.least) | (right[..., 1] < self.least)] = -np.inf
            f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
            tree.value[node] = -self.rate * whole[0] / (whole[1] + self.penalty)
            if gain[f, cut] > 1e-9:
                any_ = True
                tree.feature[node], tree.cut[node] = f, cut
                self.gains[self.features[f]] += float(gain[f, cut])
                for child, (g, h) in ((2 * node + 1, left[f, cut]), (2 * node + 2, right[f, cut])):
                    tree.value[child] = -self.rate * g / (h + self.penalty)
        return any_

    def _scored(self, state: DataFrame, grown: list[Tree]) -> DataFrame:
        features, classes, depth = len(self.features), self.classes, self.depth

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m, scores = self._held(b, features, classes)
                new = scores + np.stack([t.value[t.nodes(m, depth)] for t in grown], 1)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in new], pa.binary())], names=["bins", "y", "w", "scores"])

        return state.mapInArrow(run, "bins binary, y int, w double, scores binary")

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        scores = np.zeros((len(x), self.classes))
        for grown in self.trees:
            scores += np.stack([t.value[t.nodes(x, self.depth)] for t in grown], 1)
        p = np.exp(scores - scores.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def transform(self, df: DataFrame, name: str = "probabilities") -> DataFrame:
        """``df`` plus the classes' probabilities."""

        @F.arrow_udf("array<double>")
        def run(x: pa.Array) -> pa.Array:
            p = self.probabilities(self._matrix(x))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * self.classes, pa.int32()), pa.array(p.ravel()))

        return df.withColumn(name, run(self._x()))

    def gain_audit(self, most: float = MOST_GAIN) -> list[tuple[str, float, bool]]:
        """(feature, share of the gain, whether it may be a leak), the largest share first."""
        total = sum(self.gains.values()) or 1.0
        return sorted(((f, g / total, g / total > most) for f, g in self.gains.items()), key=lambda r: (-r[1], r[0]))


def retrained(buffer: DataFrame, new: DataFrame, features: list[str], label: str, classes: int, order: str, replay: DataFrame | None = None, at: int = BUFFER_ROWS, keep: int = KEPT_ROWS, model: SoftmaxBoosting | None = None) -> tuple[DataFrame, SoftmaxBoosting | None]:
    """The buffer with the new rows, and a model when it holds ``at`` rows: trained on all of them, each class weighing the same, classes that it lacks coming from
    ``replay``; the newest ``keep`` rows by ``order`` are left then."""
    held = written(buffer.unionByName(new), "buffer")
    sizes = {r[label]: r["n"] for r in held.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) < at:
        return held, None
    rows = held
    if replay is not None and (absent := [k for k in range(classes) if k not in sizes]):
        rows = held.unionByName(replay.where(F.col(label).isin(absent)).select(*held.columns))
        sizes |= {r[label]: r["n"] for r in rows.where(F.col(label).isin(absent)).groupBy(label).agg(F.count("*").alias("n")).collect()}
    weight = F.lit(0.0)
    for k, n in sizes.items():
        weight = F.when(F.col(label) == k, sum(sizes.values()) / (len(sizes) * n)).otherwise(weight)
    fitted = (model or SoftmaxBoosting()).fit(rows.withColumn("_weight", weight), features, label, classes, "_weight")
    return written(held.orderBy(F.desc(order)).limit(keep), "buffer"), fitted
