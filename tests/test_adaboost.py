"""AdaBoost over blocks: against brute force, and alike on both paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler

from strata.operators import adaboost as A
from strata.operators import models as M


def _views(spark, y_of, n=400, folds=2):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 60, n), rng.normal(size=n)], axis=1).astype(float)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["label"], pdf["fold"], pdf["__key"] = y_of(x, rng), np.arange(n) % folds, [f"{i:04d}" for i in range(n)]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf)).cache()
    return pdf, [(f, df.where(df.fold != f), df.where(df.fold == f)) for f in range(folds)]


def _classes(x, rng):
    return ((x[:, 0] + x[:, 2] > 4) ^ (rng.random(len(x)) < 0.1)).astype(float)


def _thresholds(v, w):
    """All midpoints of a column with few values, else those nearest to equal shares of the weight."""
    values, at = np.unique(v, return_inverse=True)
    mid, upto = (values[:-1] + values[1:]) / 2, np.cumsum(np.bincount(at, weights=w))
    if len(mid) <= A.SPLITS:
        return mid
    out, target = [], w.sum() / (A.SPLITS + 1)
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(mid[i - 1])
            target += w.sum() / (A.SPLITS + 1)
    return np.array(out)


def _brute(x, y, rounds):
    """SAMME of stumps, row by row: (feature, threshold, factor) of every round."""
    w, out = np.ones(len(y)), []
    gini = lambda m: m.sum() - (m ** 2).sum() / m.sum()
    mass = lambda k: np.array([w[k & (y == c)].sum() for c in (0, 1)])
    for _ in range(rounds):
        tried = [(gini(mass(x[:, f] <= t)) + gini(mass(x[:, f] > t)), f, t) for f in range(x.shape[1]) for t in _thresholds(x[:, f], w)]
        _, f, t = min(tried)
        left = x[:, f] <= t
        p = np.where(left, mass(left).argmax(), mass(~left).argmax())
        err = w[p != y].sum() / w.sum()
        alpha = np.log((1 - err) / err)
        out.append((f, t, alpha))
        w = w * np.exp(alpha * (p != y))
        w /= w.mean()
    return out


def test_samme_equals_brute_force_in_every_fold(spark):
    pdf, views = _views(spark, _classes)
    models, held = A.fit_views(views, "classification", 2, A.AdaParams(6))
    for f, m in models.items():
        rows = pdf[pdf.fold != f]
        want = _brute(rows[["a", "b", "c"]].to_numpy(), rows["label"].to_numpy(), 6)
        # c has more different values than bins do, so its thresholds may differ a little
        assert [int(t.feature[0]) for t in m.trees] == [v[0] for v in want]
        assert np.allclose(m.alphas, [v[2] for v in want], rtol=0.02)
    got = held.toPandas()
    assert sorted(got["key"]) == sorted(pdf["__key"]) and (got["y"] == got["prediction"]).mean() > 0.8


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_passes_over_the_cluster_and_rounds_in_a_task_agree(spark, task):
    y = _classes if task == "classification" else lambda x, rng: x[:, 0] * 3 + x[:, 1] + rng.normal(size=len(x))
    _, views = _views(spark, y, n=2000)   # nodes of many rows: no equal gains that rounding decides
    p = A.AdaParams(3, 1.0, 1 if task == "classification" else 3)
    runs = [A.fit_views(views, task, 2, p, **kw)[0] for kw in ({}, {"task_bytes": 0, "driver_bytes": 0})]
    for f in runs[0]:
        a, b = (r[f] for r in runs)
        assert np.allclose(a.alphas, b.alphas) and len(a.trees) == 3
        assert all(np.array_equal(s.feature, t.feature) and np.allclose(s.value, t.value) for s, t in zip(a.trees, b.trees))


def test_r2_weights_and_pure_stumps(spark):
    # a stump without error ends the rounds; rounds of all folds share their passes
    _, views = _views(spark, lambda x, rng: (x[:, 0] > 4).astype(float), n=120)
    m = A.fit_views(views, "classification", 2, A.AdaParams(5))[0][0]
    assert len(m.trees) == 1 and m.alphas == [1.0] and list(m.featureImportances) == [1.0]
    _, views = _views(spark, lambda x, rng: x[:, 0] * 10 + rng.normal(size=len(x)), n=300)
    m, held = A.fit_views(views, "regression", 0, A.AdaParams(10, 1.0, 3))
    got = held.toPandas()
    assert np.sqrt(((got["y"] - got["prediction"]) ** 2).mean()) < 5 and all(a > 0 for a in m[0].alphas)


def test_adaboost_trains_all_folds_at_once():
    assert M.joint_fit("AdaBoost", "classification") is not None and M.joint_fit("AdaBoost", "regression") is not None
