"""Linear models of all folds against plain solvers on each fold's rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.operators import linear
from tests.test_boost import frame


def data(n=240, classes=0, seed=2):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, 4)) * [1, 10, 0.1, 1] + [0, 5, 1000, 3]
    x[:, 3] = x[:, 3].round()
    score = x[:, 0] - 0.2 * x[:, 1] + 8 * (x[:, 2] - 1000) + rnd.normal(size=n)
    return x, score if not classes else np.digitize(score, np.quantile(score, np.arange(1, classes) / classes)).astype(float)


def views(spark, x, y, k=3):
    fold = np.arange(len(y)) % k
    return [(f, frame(spark, x[fold != f], y[fold != f]), frame(spark, x[fold == f], y[fold == f])) for f in range(k)], fold


def test_least_squares_share_a_pass(spark):
    x, y = data()
    vs, fold = views(spark, x, y)
    memo = {}
    ols, rdg, las = (linear.fit_least_squares(vs, kind, a, 5000, memo) for kind, a in (("ols", 0.0), ("ridge", 2.0), ("lasso", 0.2)))
    for f in range(3):
        a, b = x[fold != f], y[fold != f]
        c, d = a - a.mean(0), b - b.mean()
        assert np.allclose(ols[f].coefficients.toArray(), np.linalg.lstsq(c, d, rcond=None)[0], rtol=1e-6)
        assert np.allclose(rdg[f].coefficients.toArray(), np.linalg.solve(c.T @ c + 2 * np.eye(4), c.T @ d), rtol=1e-6)
        w = las[f].coefficients.toArray()
        slope = c.T @ (d - c @ w) / len(d)          # optimality: alpha * sign where active, within alpha elsewhere
        assert (w == 0).any() and (w != 0).any()
        assert np.allclose(slope[w != 0], 0.2 * np.sign(w[w != 0]), atol=1e-8) and (np.abs(slope[w == 0]) <= 0.2 + 1e-9).all()
        got = {r["__key"]: r.prediction for r in rdg[f].transform(vs[f][2]).collect()}
        want = (x[fold == f] - a.mean(0)) @ rdg[f].coefficients.toArray() + b.mean()
        assert np.allclose([got[str(i)] for i in range(len(want))], want)


def test_by_fold_merges_the_others(spark):
    x, y = data()
    df = spark.createDataFrame([(*map(float, a), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y))], "a double, b double, c double, d double, y double, fold int")
    got = linear.by_fold(df, ["a", "b", "c", "d"], "y", "fold")
    for f in range(4):
        z = np.concatenate([x, y[:, None]], 1)[np.arange(len(y)) % 4 != f]
        assert got[f].n == len(z) and np.allclose(got[f].mean, z.mean(0)) and np.allclose(got[f].scatter, (z - z.mean(0)).T @ (z - z.mean(0)))


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_reaches_the_optimum_for_all_folds(spark, classes):
    x, y = data(classes=classes)
    vs, fold = views(spark, x, y)
    got, passes = linear.fit_logistic(vs, classes, 1.0)
    assert passes < 25
    for f in range(3):
        a, t = x[fold != f], y[fold != f].astype(int)
        m = a @ got[f].w.T + got[f].intercept
        if classes == 2:
            p = 1 / (1 + np.exp(-m))
            g = (p[:, 0] - t) @ a + got[f].w[0]
            assert abs((p[:, 0] - t).sum()) < 1e-3 and np.abs(g).max() < 1e-2 * np.abs(a).max()
        else:
            e = np.exp(m - m.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True) - np.eye(classes)[t]
            assert np.abs(p.T @ (a - a.mean(0)) + got[f].w).max() < 1e-3 * np.abs(a).max()
        one = linear.Logistic(classes).fit(vs[f][1])
        assert np.allclose(one.w, got[f].w, rtol=1e-5, atol=1e-7)
        out = got[f].transform(vs[f][2]).select("prediction", F.col("probability")).collect()
        assert all(r.prediction == np.argmax(r.probability.toArray()) and abs(sum(r.probability) - 1) < 1e-9 for r in out)


def test_logistic_weights_stand_for_equal_rows():
    rnd = np.random.default_rng(3)
    x, w = rnd.normal(size=(40, 3)), rnd.integers(1, 5, 40)
    for k in (1, 3):
        y, point = rnd.integers(0, max(k, 2), 40).astype(float), rnd.normal(size=(k, 4))

        def batch(x, y, **more):
            return pa.record_batch({"model": pa.array([0] * len(x), pa.int32()), "x": pa.array(list(x), pa.list_(pa.float64())), "y": pa.array(y), **more})

        shift = {0: (np.zeros(3), np.ones(3))}
        a = next(linear._curves({0: point}, shift)(iter([batch(x, y, w=pa.array(w.astype(float)))]))).to_pylist()[0]
        b = next(linear._curves({0: point}, shift)(iter([batch(np.repeat(x, w, axis=0), np.repeat(y, w))]))).to_pylist()[0]
        assert abs(a["n"] - b["n"]) < 1e-9
        assert all(np.allclose(np.frombuffer(a[c]), np.frombuffer(b[c])) for c in ("mean", "scatter"))


def test_curvature_of_all_pairs_in_one_product(monkeypatch):
    """The product over pieces of rows equals the sum of each pair of classes."""
    rng = np.random.default_rng(7)
    z, p, r = rng.normal(size=(37, 4)), rng.random((37, 3)), rng.integers(0, 4, 37).astype(float)
    p /= p.sum(axis=1, keepdims=True)
    monkeypatch.setattr(linear, "PIECE_ROWS", 10)
    want = np.block([[(z * (r * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ z for j in range(3)] for i in range(3)])
    assert np.allclose(linear._curvature(z, p, r), want, rtol=1e-12, atol=1e-12)


def test_board_is_scored_once(spark):
    """Reading the leaderboard does not score the out-of-fold rows again."""
    from strata.operators import train as T
    df = spark.range(120).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"), (F.col("id") % 3).cast("string").alias("c"))
    res = T.train(df, "c", "classification", key_cols=["id"], models=["Logistic Regression", "Naive Bayes"], k=2, refit=False)
    plan = res.leaderboard._jdf.queryExecution().toString()
    assert "InMemory" not in plan and "Aggregate" not in plan
    assert [r["rank"] for r in res.leaderboard.collect()] == [1, 2]


def test_products_of_folds_without_their_vectors(spark, monkeypatch):
    """Least squares of all folds from one pass over shared columns: NULLs filled by each fold's median, categories that a fold lacks."""
    from strata.operators import train as T

    rng = np.random.default_rng(5)
    n = 600
    rows = [(i, None if i % 7 == 0 else float(1e6 + rng.normal()), float(rng.normal()), None if i % 11 == 0 else "abc"[i % 3] if i != 1 else "rare",
             bool(i % 2), float(rng.normal() + i % 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string, d boolean, y double")
    seen = {}
    keep = linear.fit_least_squares

    def spied(views, kind, alpha, max_iter, memo):
        given = memo["products"]
        for m, p in linear.products(linear._view_rows(views)).items():
            assert given[m].n == p.n
            np.testing.assert_allclose(given[m].mean, p.mean, rtol=1e-9, atol=1e-8)
            np.testing.assert_allclose(given[m].scatter, p.scatter, rtol=1e-6, atol=1e-4)
            seen[m, kind] = len(p.mean)
        return keep(views, kind, alpha, max_iter, memo)

    monkeypatch.setattr(linear, "fit_least_squares", spied)
    for scaler in ("standard", "robust"):
        seen.clear()
        res = T.train(df, "y", "regression", key_cols=["id"], models=["Linear Regression", "Ridge"], k=3, refit=False, scaler=scaler)
        assert res.status == "complete" and not res.errors and len(seen) == 6 and len(set(seen.values())) == 2   # one fold never trains on "rare"
        assert res.oof.count() == 2 * n and res.fold_losses.count() == 6
    monkeypatch.setattr(linear, "MAX_WIDTH", 3)
    assert T._shared_products(df.withColumn("fold", F.lit(0)).withColumn("label", F.col("y")), {0: T.Recipe(["a"], {"a": 0.0}, {"a": (0.0, 1.0)}, {"c": list("abc")})}, {"a"}) is None
