"""A linear classifier that learns batch by batch: gradients are summed where the rows are, and only their sum reaches the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import finite


@dataclass
class OnlineLinear:
    """Binary labels. ``loss``: log, or huber (modified: linear for rows far on the wrong side). Each class has the same weight in a batch where
    ``balanced``. Missing features count as 0, so scale them first."""

    features: list[str]
    loss: str = "log"
    rate: float = 0.5
    l2: float = 1e-4
    balanced: bool = True
    steps: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        if self.loss not in ("log", "huber"):
            raise ValueError("loss must be log or huber")
        if not len(self.weights):
            self.weights = np.zeros(len(self.features) + 1)

    def _inputs(self) -> list[Column]:
        return [F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(self.features)]

    def partial_fit(self, batch: DataFrame, label: str, passes: int = 1) -> OnlineLinear:
        """``passes`` steps over a batch; rows without a label are left out."""
        d = batch.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *self._inputs())
        if passes > 1:
            d = d.persist()
        counts = {r["y"]: r["n"] for r in d.groupBy((F.col("y") > 0).cast("double").alias("y")).agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        mass = {y: (total / (len(counts) * n) if self.balanced else 1.0) for y, n in counts.items()}
        for _ in range(passes if total else 0):
            w, loss, size = self.weights.copy(), self.loss, len(self.features)

            def gradient(pages, w=w, loss=loss, size=size):
                out = np.zeros(size + 1)
                for p in pages:
                    x = np.column_stack([*[p.column(i + 1).to_numpy(zero_copy_only=False) for i in range(size)], np.ones(p.num_rows)])
                    y = np.where(p.column(0).to_numpy(zero_copy_only=False) > 0, 1.0, -1.0)
                    m = np.where(y > 0, mass.get(1.0, 0.0), mass.get(0.0, 0.0))
                    z = y * (x @ w)
                    slope = -1 / (1 + np.exp(np.clip(z, -50, 50))) if loss == "log" else np.where(z < -1, -4.0, np.where(z < 1, -2 * (1 - z), 0.0))
                    out += (m * slope * y) @ x
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(out)], names=["i", "g"])

            rows = d.mapInArrow(gradient, "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()  # a row per feature
            g = np.zeros(size + 1)
            for r in rows:
                g[r["i"]] = r["g"] / total
            g[:-1] += self.l2 * w[:-1]
            self.steps += 1
            self.weights = w - self.rate / self.steps**0.25 * g
        if passes > 1:
            d.unpersist()
        return self

    def decision(self) -> Column:
        """The score of a row: positive for class 1."""
        out = F.lit(float(self.weights[-1]))
        for c, w in zip(self.features, self.weights[:-1], strict=True):
            out = out + F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) * F.lit(float(w))
        return out
