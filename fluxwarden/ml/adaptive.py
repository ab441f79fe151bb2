"""An adaptive random forest over micro-batches: Hoeffding trees whose leaves hold counts that add up, and a drift detector for each tree.

A batch is tested, then learned, in one pass: tasks send each row down every tree, count what the trees say wrongly in slices of the batch's time, and add the row's bins and
class to the counts of its leaves, with a weight from a Poisson distribution that is a function of the row and the tree (so a task run again counts the same). Counts of
tasks are added where they meet; the driver gets a table of counts per touched leaf, whose size depends on the forest alone. There a leaf is split when its best
feature is better than the next by Hoeffding's bound. A tree whose error rises gets a successor in the background, which takes its place when the rise is sure.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import finite
from ..streaming.twins import Adwin

#: Slices of a batch's time whose mean errors the detectors see one by one; how sure they are of a warning and of a drift.
SLICES, MOST_SLICES, WARN, DRIFT = 16, 128, 0.05, 0.002

COUNTS = "kind int, node bigint, total binary"


def poisson(keys: np.ndarray, tree: int, mean: float = 6.0) -> np.ndarray:
    """A weight for each row and tree, by inverting the distribution at a hash of both."""
    with np.errstate(over="ignore"):
        h = (keys.astype(np.uint64) + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
    steps = np.cumsum([math.exp(-mean) * mean**k / math.factorial(k) for k in range(30)])
    return np.searchsorted(steps, (h >> np.uint64(11)).astype(float) / (1 << 53))


class SliceWindow(Adwin):
    """The drift detector over slices of many values each, the newest first; beyond ``MOST_SLICES`` the oldest two become one."""

    def rose(self, n: float, wrong: float) -> bool:
        mean = lambda: sum(b[1] for b in self.buckets) / max(1, sum(b[0] for b in self.buckets))
        self.buckets.insert(0, (n, wrong))
        if len(self.buckets) > MOST_SLICES:
            (a, x), (b, y) = self.buckets[-2:]
            self.buckets[-2:] = [(a + b, x + y)]
        before = mean()
        return self._cut() and mean() > before


class HoeffdingTree:
    """Nodes as lists; a leaf's counts are by feature, bin and class."""

    def __init__(self, features: np.ndarray, bins: int, classes: int):
        self.features, self.bins, self.classes = features, bins, classes
        self.feature, self.cut, self.left, self.right = [-1], [0], [-1], [-1]
        self.counts = {0: np.zeros((len(features), bins, classes))}
        self.prior = {0: np.zeros(classes)}
        self.seen = {0: 0.0}

    def leaves(self, m: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(m), np.int64), np.arange(len(m))
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            f = np.maximum(feature[at], 0)
            at = np.where(inner, np.where(m[rows, f] <= cut[at], left[at], right[at]), at)
        return at

    def votes(self) -> np.ndarray:
        """The share of each class at every node (of inner ones nothing)."""
        out = np.zeros((len(self.feature), self.classes))
        for leaf, c in self.counts.items():
            v = c[0].sum(0) + self.prior[leaf]
            out[leaf] = v / v.sum() if v.sum() else 1 / self.classes
        return out

    def learn(self, leaf: int, counts: np.ndarray, grace: float, delta: float, tie: float, most: int) -> None:
        held = self.counts[leaf] = self.counts[leaf] + counts
        n = held[0].sum()
        if n - self.seen[leaf] < grace or len(self.counts) >= most:
            return
        self.seen[leaf] = n
        entropy = lambda c: -(np.where(c > 0, c, 0) * np.log2(np.where(c > 0, c, 1) / np.maximum(c.sum(-1, keepdims=True), 1e-12))).sum(-1)
        below = np.cumsum(held, 1)[:, :-1]
        above = held[0].sum(0) - below
        gain = (entropy(held[0].sum(0)) - entropy(below) - entropy(above)) / n
        best = gain.max(1)
        order = np.argsort(-best)
        bound = math.sqrt(math.log2(self.classes) ** 2 * math.log(1 / delta) / (2 * n))
        second = best[order[1]] if len(order) > 1 else 0.0
        if best[order[0]] > 0.01 and (best[order[0]] - second > bound or bound < tie):
            f, cut = int(order[0]), int(gain[order[0]].argmax())
            self.feature[leaf], self.cut[leaf] = int(self.features[f]), cut
            self.left[leaf], self.right[leaf] = len(self.feature), len(self.feature) + 1
            for part in (below[f, cut], above[f, cut]):
                new = len(self.feature)
                self.feature.append(-1)
                self.cut.append(0)
                self.left.append(-1)
                self.right.append(-1)
                self.counts[new], self.prior[new], self.seen[new] = np.zeros_like(held), part * 1.0, 0.0
            del self.counts[leaf]


@dataclass
class AdaptiveForest:
    features: list[str]
    classes: int
    trees: int = 10
    bins: int = 32
    grace: float = 200.0
    delta: float = 0.01
    tie: float = 0.05
    most_leaves: int = 64
    seed: int = 7
    edges: list[np.ndarray] | None = None
    drifts: list[tuple[int, int]] = field(default_factory=list)
    batches: int = 0

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)
        self.forest = [self._new() for _ in range(self.trees)]
        self.successors: list[HoeffdingTree | None] = [None] * self.trees
        self.detectors = [(SliceWindow(WARN), SliceWindow(DRIFT)) for _ in range(self.trees)]

    def _new(self) -> HoeffdingTree:
        n = min(len(self.features), round(math.sqrt(len(self.features))) + 1)
        return HoeffdingTree(np.sort(self.rng.choice(len(self.features), n, replace=False)), self.bins, self.classes)

    def _matrix(self, column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.features))
        return np.stack([np.where(np.isnan(x[:, f]), 0, np.searchsorted(e, x[:, f])) for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.features)), np.int64)

    def _x(self):
        return F.array(*[F.coalesce(finite(F.col(c).cast("double")), F.lit(float("nan"))) for c in self.features]).alias("x")

    def learn(self, batch: DataFrame, label: str, order: str) -> tuple[int, int]:
        """Tests and then learns a batch (``label`` from 0, ``order`` a number that rises with time): rows and how many of them the forest had right before."""
        if self.edges is None:
            shares = F.array(*[F.lit(k / self.bins) for k in range(1, self.bins)])
            row = batch.agg(*[F.percentile_approx(finite(F.col(c).cast("double")), shares).alias(c) for c in self.features]).first()
            self.edges = [np.unique(np.array(row[c] or [0.0])) for c in self.features]
        ends = batch.agg(F.min(order).alias("a"), F.max(order).alias("z")).first()
        if ends["a"] is None:
            return 0, 0
        width = max(float(ends["z"]) - float(ends["a"]), 1e-9)
        at = F.least(F.floor((F.col(order).cast("double") - float(ends["a"])) / width * SLICES), F.lit(SLICES - 1)).cast("int")
        rows = batch.where(F.col(label).isNotNull()).select(self._x(), F.col(label).cast("int").alias("y"), at.alias("slice"), F.xxhash64(order, *self.features).alias("key"))
        found = rows.mapInArrow(self._counter(), COUNTS).repartition("kind", "node").mapInArrow(_added, COUNTS)
        errors, right, n = np.zeros((self.trees, SLICES, 2)), 0, 0
        grown = [*self.forest, *self.successors]
        for r in found.toLocalIterator():  # one row for each touched leaf
            total = np.frombuffer(bytes(r["total"]), np.float64)
            if r["kind"] == 0:
                right, n = right + int(total[0]), n + int(total[1])
            elif r["kind"] == 1:
                errors += total.reshape(errors.shape)
            else:
                tree = grown[r["node"] >> 32]
                tree.learn(int(r["node"] & 0xFFFFFFFF), total.reshape(len(tree.features), self.bins, self.classes), self.grace, self.delta, self.tie, self.most_leaves)
        self._adapt(errors)
        self.batches += 1
        return n, right

    def _counter(self):
        edges, grown, trees, classes, bins = self.edges, [*self.forest, *self.successors], self.trees, self.classes, self.bins
        self.edges = edges
        matrix = self._matrix

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[int, np.ndarray] = {}
            errors, whole = np.zeros((trees, SLICES, 2)), np.zeros(2)
            votes = [t.votes() if t else None for t in grown]
            for b in batches:
                m, y, s, key = matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
                said = np.zeros((len(m), classes))
                for k, tree in enumerate(grown):
                    if tree is None:
                        continue
                    leaf = tree.leaves(m)
                    share = votes[k][leaf]
                    if k < trees:
                        said += share
                        np.add.at(errors[k], (s, 0), 1)
                        np.add.at(errors[k], (s, 1), share.argmax(1) != y)
                    weight = poisson(key, k)
                    for node in np.unique(leaf):
                        own = np.flatnonzero(leaf == node)
                        held = counts.setdefault(k << 32 | int(node), np.zeros((len(tree.features), bins, classes)))
                        for f, column in enumerate(tree.features):
                            np.add.at(held[f], (m[own, column], y[own]), weight[own])
                whole += ((said.argmax(1) == y).sum(), len(m))
            out = [(0, 0, whole), (1, 0, errors), *[(2, node, c) for node, c in counts.items()]]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2].tobytes() for o in out], pa.binary())], names=["kind", "node", "total"])

        return run

    def _adapt(self, errors: np.ndarray) -> None:
        for k in range(self.trees):
            for n, wrong in errors[k]:
                if not n:
                    continue
                warned, sure = [d.rose(n, wrong) for d in self.detectors[k]]
                if sure:
                    self.forest[k], self.successors[k] = self.successors[k] or self._new(), None
                    self.detectors[k] = (SliceWindow(WARN), SliceWindow(DRIFT))
                    self.drifts.append((self.batches, k))
                    break
                if warned and self.successors[k] is None:
                    self.successors[k] = self._new()

    def transform(self, df: DataFrame, name: str = "probabilities") -> DataFrame:
        """``df`` plus the mean of the trees' shares of the classes."""
        votes = [t.votes() for t in self.forest]

        @F.arrow_udf("array<double>")
        def run(x: pa.Array) -> pa.Array:
            m = self._matrix(x)
            p = sum(v[t.leaves(m)] for t, v in zip(self.forest, votes, strict=True)) / self.trees
            return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * self.classes, pa.int32()), pa.array(np.ravel(p)))

        return df.withColumn(name, run(self._x()))

    def writer(self, stream: DataFrame, label: str, order: str, told=None):
        """A writer that learns each micro-batch of a stream; ``told`` gets (batch, rows, right)."""
        return stream.writeStream.foreachBatch(lambda batch, i: (told or (lambda *_: None))(i, *self.learn(batch, label, order)))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, np.ndarray] = {}
    for b in batches:
        for kind, node, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
            part = np.frombuffer(total, np.float64)
            sums[kind, node] = sums[kind, node] + part if (kind, node) in sums else part
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["kind", "node", "total"])
