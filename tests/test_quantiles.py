"""Exact quantiles against NumPy: brackets of any size, many equal values, missing ones, features without values."""

import random

import numpy as np
import pytest

from fluxwarden.ml import models


@pytest.mark.parametrize(("around", "fine"), [(10_000, 10_000), (50, 200), (5, 40), (0, 1_000)])
def test_quantiles(spark, monkeypatch, around, fine):
    monkeypatch.setattr(models, "AROUND", around)
    monkeypatch.setattr(models, "FINE", fine)
    rng = random.Random(around)
    rows = [(rng.gauss(0, 1), rng.choice([1.0, 1.0, 1.0, 2.0, rng.random()]), float(rng.randrange(3)), rng.choice([None, float("nan"), float("inf"), 5.0 * rng.random()]), None, 7.0) for _ in range(3_000)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(4)
    got = models.quantiles(d, list("abcdef"), (0.0, 0.25, 0.5, 0.75, 0.99, 1.0))
    assert got["e"] is None
    for k, name in enumerate("abcdf"):
        x = [r["abcdef".index(name)] for r in rows]
        x = [v for v in x if v is not None and np.isfinite(v)]
        assert got[name] == pytest.approx(np.quantile(x, [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]).tolist(), rel=1e-12), (k, name)
    assert models.medians(d.limit(0), ["a"]) == {"a": (0.0, 1.0)}
