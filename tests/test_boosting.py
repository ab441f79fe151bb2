"""Softmax boosting against a small plain version of itself, held-out accuracy, the audit on a planted leak, the buffer."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxwarden.ml.boosting import SoftmaxBoosting, retrained


def rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = rng.random(), rng.random(), rng.random()
        y = 0 if a < 0.4 else 1 if b < 0.5 else 2 if a + b < 1.4 else 3
        out.append((i, a, b if rng.random() > 0.05 else None, c, y, float(y) + rng.random() * 0.01))
    return out


SCHEMA = "id int, a double, b double, c double, y int, leak double"


def plain(x, y, edges, classes, rounds, depth, rate, bins):
    """The same rules with loops over rows: probabilities of the training rows."""
    m = [[0 if v is None else int(np.searchsorted(e, v)) for v, e in zip(r, edges, strict=True)] for r in x]
    scores = np.zeros((len(x), classes))

    def grow(own, g, h, level):
        total_g, total_h = g[own].sum(), h[own].sum()
        best = None
        if level < depth:
            for f in range(len(edges)):
                for cut in range(bins - 1):
                    left = np.array([i for i in own if m[i][f] <= cut], int)
                    right = np.array([i for i in own if m[i][f] > cut], int)
                    if h[left].sum() < 1 or h[right].sum() < 1:
                        continue
                    gain = 0.5 * (g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - total_g**2 / (total_h + 1))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, left, right
        if best is None:
            return {int(i): -rate * total_g / (total_h + 1) for i in own}
        return grow(best[1], g, h, level + 1) | grow(best[2], g, h, level + 1)

    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        add = np.zeros_like(scores)
        for k in range(classes):
            for i, v in grow(np.arange(len(x)), p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k]), 0).items():
                add[i, k] = v
        scores = scores + add
    return np.exp(scores) / np.exp(scores).sum(1, keepdims=True)


def test_against_the_plain_version(spark):
    data = rows(1, 150)
    d = spark.createDataFrame(data, SCHEMA).repartition(3)
    model = SoftmaxBoosting(rounds=3, depth=2, rate=0.3, bins=8).fit(d, ["a", "b", "c"], "y", 4)
    got = {r["id"]: r["probabilities"] for r in model.transform(d).collect()}
    want = plain([r[1:4] for r in data], np.array([r[4] for r in data]), model.edges, 4, 3, 2, 0.3, 8)
    assert np.allclose([got[r[0]] for r in data], want)


def test_it_learns_and_tells_leaks(spark):
    d = spark.createDataFrame(rows(2, 1_500), SCHEMA)
    model = SoftmaxBoosting(rounds=6, depth=3, rate=0.4, bins=32).fit(d, ["a", "b", "c"], "y", 4)
    new = model.transform(spark.createDataFrame(rows(3, 500), SCHEMA)).select("y", F.expr("array_position(probabilities, array_max(probabilities)) - 1").alias("p"))
    assert new.where("y = p").count() >= 450
    assert model.gain_audit()[-1][0] == "c" and sum(r[1] for r in model.gain_audit()) == pytest.approx(1)
    leaky = SoftmaxBoosting(rounds=2, depth=2, bins=16).fit(d, ["a", "b", "leak"], "y", 4)
    assert leaky.gain_audit()[0][0] == "leak" and leaky.gain_audit()[0][2]
    nothing = SoftmaxBoosting(rounds=2).fit(d.limit(0), ["a"], "y", 2)
    assert nothing.trees == [] and nothing.transform(d.limit(1)).first()["probabilities"] == [0.5, 0.5]


def test_buffer(spark):
    d = spark.createDataFrame(rows(4, 300), SCHEMA)
    some, rest = d.where("id < 100 and y < 2"), d.where("id >= 100 and y < 2")
    held, model = retrained(some, d.limit(0), ["a", "b"], "y", 4, "id", at=150)
    assert model is None and held.count() == some.count()
    kept, model = retrained(held, rest, ["a", "b"], "y", 4, "id", replay=d.where("y >= 2"), at=150, keep=20, model=SoftmaxBoosting(rounds=2, depth=2))
    assert kept.count() == 20 and kept.agg(F.min("id")).first()[0] > 200
    found = model.transform(d).select("y", F.expr("array_position(probabilities, array_max(probabilities)) - 1").alias("p"))
    assert found.where("y = p").count() >= 240
