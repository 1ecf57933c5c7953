"""Tree Shapley values against enumeration over all feature subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from strata.operators import boost, forest, models, treeshap
from tests.test_boost import frame, table


def expectation(t, x, known, i=0):
    """The tree's value when only the features in ``known`` are known."""
    f = t.feature[i]
    if f < 0:
        return t.value[i]
    l, r = t.left[i], t.right[i]
    if f in known:
        left = t.missing_left[i] if np.isnan(x[f]) else x[f] <= t.threshold[i]
        return expectation(t, x, known, l if left else r)
    return (t.cover[l] * expectation(t, x, known, l) + t.cover[r] * expectation(t, x, known, r)) / t.cover[i]


def enumerated(t, x):
    p = len(x)
    out = np.zeros((p, t.value.shape[1]))
    for f in range(p):
        others = [g for g in range(p) if g != f]
        for k in range(p):
            for s in combinations(others, k):
                w = factorial(k) * factorial(p - k - 1) / factorial(p)
                out[f] += w * (expectation(t, x, {*s, f}) - expectation(t, x, set(s)))
    return out


@pytest.mark.parametrize("width,classes", [(4, 0), (8, 3)])
def test_equal_to_enumeration(width, classes):
    rnd = np.random.default_rng(width)
    x = rnd.integers(0, 6, (300, width)).astype(np.float32)
    y = x[:, 0] * x[:, 1] + x[:, -1] + rnd.normal(size=300) * 0.2
    goal = forest._goal(np.digitize(y, np.quantile(y, [0.4, 0.7])).astype(float), classes) if classes else y[:, None]
    t = forest.grow(x, goal, forest.weights(np.arange(300), 0, 0, 1), forest.ForestParams(depth=7), 0, 0)
    some = x[:6].astype(float)
    some[0, 1] = np.nan
    got, mean = treeshap.tree_shap(t, some)
    for i, row in enumerate(some):
        assert np.allclose(got[i], enumerated(t, row), atol=1e-9)
    assert np.allclose(mean, expectation(t, some[0], set()))
    assert np.allclose(got.sum(axis=1) + mean, t.predict(some))


@pytest.mark.parametrize("kind", ["boost", "forest", "tree"])
def test_models_add_up(spark, kind):
    x, y = table(n=120, missing=0, classes=2)
    df = frame(spark, x, y)
    if kind == "boost":
        model = boost.HistBooster(boost.depth_wise({"n_estimators": 3, "learning_rate": 0.3, "max_depth": 3}), "classification").fit(df)
    elif kind == "forest":
        model = forest.Forest(forest.ForestParams(6, 5, features="sqrt"), "classification").fit(df)
    else:
        model = models.get_model("Decision Tree", "classification", models.FitContext(120), {"max_depth": 4}).fit(df)
    one = frame(spark, x, y, None).coalesce(1)
    sums = {}
    for r in treeshap.shap_values(model, one, 4).collect():
        sums.setdefault(r.row, {}).setdefault(r.output, 0.0)
        sums[r.row][r.output] += r.phi
    scored = model.transform(one).collect()
    if kind == "boost":
        rest = [model.margins(r.features.toArray()[None])[0, 0] - sums[i][0] for i, r in enumerate(scored)]
    else:
        rest = [r.probability[1] - sums[i][1] for i, r in enumerate(scored)]
    assert np.ptp(rest) < 1e-9  # prediction minus values is the expectation, the same for all rows
    names = [f"f{i}" for i in range(4)]
    imp = {r.feature: r.importance for r in treeshap.shap_importance(model, one, names).collect()}
    assert set(imp) == set(names) and min(imp.values()) >= 0 and max(imp.values()) > 0
