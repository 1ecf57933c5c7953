"""Forests against a plain recursive learner with the same draws; leaves pure or too small; both phases."""

import pickle

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from strata.operators import forest
from tests.test_boost import frame, table


def plain(x, y, w, p, m, t):
    """Leaf values by rows for one tree, by trying every threshold; also the leaf sizes."""
    out = np.zeros((len(x), y.shape[1]))
    sizes = []

    def score(rows):
        s = (w[rows, None] * y[rows]).sum(axis=0)
        return (s * s).sum() / w[rows].sum()

    def walk(rows, everyone, path, depth):
        best, at = 1e-9, None
        drawn = rows[w[rows] > 0]
        pure = len(np.unique(y[drawn], axis=0)) == 1
        if not pure and len(drawn) >= max(p.min_split, 2 * p.min_leaf) and (not p.depth or depth < p.depth):
            may = forest.allowed(np.array([path], np.uint64), x.shape[1], p.width(x.shape[1]), m, t, p.seed)[0]
            for f in np.flatnonzero(may):
                v = np.unique(x[drawn, f]).astype(float)
                for c in (v[:-1] + v[1:]) / 2:
                    a, b = drawn[x[drawn, f] <= c], drawn[x[drawn, f] > c]
                    if min(len(a), len(b)) >= p.min_leaf and (g := score(a) + score(b) - score(drawn)) > best * (1 + 1e-9):
                        best, at = g, (f, c)
        if at is None:
            out[everyone] = (w[drawn, None] * y[drawn]).sum(axis=0) / w[drawn].sum()
            sizes.append((len(drawn), pure))
            return
        f, c = at
        for side in (0, 1):
            go = (x[:, f] > c) if side else (x[:, f] <= c)
            walk(rows[go[rows]], everyone[go[everyone]], int(forest.child_path(np.array([path], np.uint64), side)[0]), depth + 1)

    walk(np.arange(len(x)), np.arange(len(x)), 1, 0)
    return out, sizes


@pytest.mark.parametrize("classes,p", [(0, forest.ForestParams(4)), (2, forest.ForestParams(4, 10, 10, 4, "sqrt")), (3, forest.ForestParams(3, 0, 2, 1, "sqrt"))])
def test_trees_equal_plain_learner(classes, p):
    x, y = table(n=220, missing=0, classes=classes)
    x, goal = x.astype(np.float32), forest._goal(y, classes)
    for t in range(p.trees):
        w = forest.weights(np.arange(len(y)), 0, t, p.seed)
        got = forest.grow(x, goal, w, p, 0, t)
        want, sizes = plain(x, goal, w, p, 0, t)
        assert np.allclose(got.predict(x), want)
        assert (got.feature < 0).sum() == len(sizes)
        assert abs(w.mean() - 1) < 0.3


def test_unlimited_leaves_are_pure():
    x, y = table(n=400, missing=0)
    p = forest.ForestParams()
    w = forest.weights(np.arange(400), 0, 0, 1)
    t = forest.grow(x.astype(np.float32), y[:, None], w, p, 0, 0)
    leaf = t.leaf_of(x)
    for i in np.unique(leaf[w > 0]):
        rows = (leaf == i) & (w > 0)
        assert len(np.unique(y[rows])) == 1 or len(np.unique(x[rows].astype(np.float32), axis=0)) == 1


@pytest.mark.parametrize("classes", [0, 3])
def test_both_phases_equal_exact_growth(spark, classes):
    # few distinct values: every threshold is a bin border, so histograms choose as exact search does
    x, y = table(n=600, missing=0, classes=classes)
    task = "classification" if classes else "regression"
    p = forest.ForestParams(5, features="sqrt" if classes else "all")
    df = frame(spark, x, y, None).coalesce(1)
    views = [(0, df, df)]
    one, held_one = forest.fit_views(views, task, classes, p)
    two, held_two = forest.fit_views(views, task, classes, p, small_rows=40, driver_bytes=0 if classes else 1 << 26)
    a, b = ({r.tree: pickle.loads(r.blob) for r in m[0].trees.collect()} for m in (one, two))
    assert sorted(a) == sorted(b) == list(range(5))
    for t in a:
        # the same partition of the drawn rows; histograms may cut elsewhere between two values of a node
        drawn = forest.weights(np.arange(600), 0, t, p.seed) > 0
        assert (a[t].feature < 0).sum() == (b[t].feature < 0).sum()
        assert np.allclose(a[t].predict(x.astype(np.float32))[drawn], b[t].predict(x.astype(np.float32))[drawn])
    for m, held in ((one, held_one), (two, held_two)):
        want = {r.key: r.prediction for r in held.collect()}
        assert len(want) == 600 and all(abs(r.prediction - want[r["__key"]]) < 1e-9 for r in m[0].transform(df).collect())
    assert abs(one[0].featureImportances.sum() - 1) < 1e-9 and len(one[0].featureImportances) == 4


@pytest.mark.parametrize("p", [forest.ForestParams(3, 10, 10, 4, "sqrt"), forest.ForestParams(2)])
def test_sets_of_equal_rows_grow_the_trees_of_their_rows(p):
    x, y = table(n=90, missing=0, classes=2)
    x, n = x.astype(np.float32), np.random.default_rng(5).integers(1, 9, 90)
    of, goal = np.repeat(np.arange(90), n), forest._goal(y, 2)
    for t in range(p.trees):
        w = forest.weights(np.arange(len(of)), 0, t, p.seed)
        rows = forest.grow(x[of], goal[of], w, p, 0, t)
        sets = forest.grow(x, goal, np.bincount(of, w), p, 0, t, rows_of=np.bincount(of, w > 0))
        assert np.array_equal(rows.feature, sets.feature) and np.allclose(rows.value, sets.value)
        assert np.array_equal(rows.threshold, sets.threshold, equal_nan=True)


def test_draws_of_sets_are_sums_of_poisson_draws():
    n = np.full(4000, 50.0)
    w, rows = forest.drawn(n, 1, 2, 42)
    assert abs(w.mean() - 50) < 0.6 and abs(w.var() - 50) < 5
    assert abs(rows.mean() - 50 * (1 - np.exp(-1))) < 0.4 and (rows <= w).all() and (rows <= n).all()
    assert np.array_equal(w, forest.drawn(n, 1, 2, 42)[0])


def test_large_view_of_few_different_rows(spark, monkeypatch):
    from strata.operators import cells
    monkeypatch.setattr(cells, "MERGE_FROM", 0)
    x, y = table(n=60, missing=0, classes=2)
    x, y = np.repeat(x, 9, axis=0), np.repeat(y, 9)
    monkeypatch.setattr(forest, "_large", None)     # no passes over histograms
    p = forest.ForestParams(8, 10, 10, 4, "sqrt")
    models, held = forest.fit_views([(f, frame(spark, x, y), frame(spark, x, y)) for f in range(2)], "classification", 2, p, small_rows=100)
    assert all(models[f].trees.count() == 8 for f in range(2))
    got = held.collect()
    assert len(got) == 2 * len(x) and np.mean([r.prediction == r.y for r in got]) > 0.8


def test_regression_forest_over_sets_of_features(spark, monkeypatch):
    """where rows of equal features are many, sums over them grow the trees that the rows themselves give."""
    from strata.operators import cells
    monkeypatch.setattr(cells, "MERGE_FROM", 100)
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 12, 3000) / 7, rng.integers(0, 4, 3000) / 3, rng.integers(0, 3, 3000)], 1).astype(float)
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=3000)
    df = spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))], "__key int, v array<double>, label double").select(
        "__key", array_to_vector("v").alias("features"), "label").localCheckpoint()
    params = forest.ForestParams(6)
    views = [(f, df.where(F.col("__key") % 2 != f), df.where(F.col("__key") % 2 == f)) for f in range(2)]
    used = []
    own = forest._of_sums
    monkeypatch.setattr(forest, "_of_sums", lambda *a: used.append(a[1]) or own(*a))
    monkeypatch.setattr(forest, "SUM_BYTES", 32 * 300 * 4)          # several passes
    by_sets, held = forest.fit_views(views, "regression", 0, params, small_rows=1000)
    assert len(used) == 1 and all(len(s.x) <= 144 for s in used[0].values())
    by_rows, expected = forest.fit_views(views, "regression", 0, params, small_rows=10_000)
    z = x.astype(np.float32)
    for m in by_sets:
        for a, b in zip(*(next(v[m].chunks()) for v in (by_sets, by_rows))):
            assert len(a.feature) == len(b.feature) > 50 and a.cover[0] == b.cover[0]
            np.testing.assert_allclose(a.predict(z), b.predict(z), atol=1e-9)
    one, other = ({(r["model"], r["key"]): (r["y"], r["prediction"]) for r in d.select("model", F.col("key").cast("string"), "y", "prediction").collect()} for d in (held, expected))
    assert one.keys() == other.keys() and len(one) == 3000
    np.testing.assert_allclose([one[k] for k in sorted(one)], [other[k] for k in sorted(one)], atol=1e-9)
