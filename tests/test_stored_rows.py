"""Large trainings: rows stored instead of cached, equal rows as weighted cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import cv as CV
from strata.operators import forest, linear
from strata.operators import train as T
from strata.operators.cells import WEIGHT, cells
from strata.operators.foldstats import fold_statistics

SHORT = {m: {"n_estimators": 3} for m in ("XGBoost", "LightGBM", "Gradient Boosting", "AdaBoost", "Random Forest")}


def frame(spark, n=1500):
    """Features of few values with gaps, a class and a number that follow them with noise."""
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 13 == 0 else float(rng.integers(0, 5)), float(rng.integers(0, 3)) / 10, None if i % 17 == 0 else "abc"[rng.integers(0, 3)], bool(i % 2),
             float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string, d boolean, noise double").localCheckpoint()
    y = F.coalesce("a", F.lit(2.0)) + F.col("b") * 20 + F.when(F.col("c") == "a", 2.0).otherwise(0.0)
    return (df.select("id", "a", "b", "c", "d", (y + F.col("noise") > 5).cast("string").alias("target")),
            df.select("id", "a", "b", "c", "d", (y + F.col("noise")).alias("target")))


def both(df, task, models, monkeypatch, **more):
    """The same training with cached and with stored rows: board and out-of-fold rows of each."""
    out = []
    for limit in (10 ** 9, 100):
        monkeypatch.setattr(T, "STORE_FROM", limit)
        monkeypatch.setattr(CV, "NARROW_ROWS", limit)
        res = T.whole(T.train(df, "target", task, key_cols=["id"], models=models, model_params=SHORT, k=2, refit=False, **more))
        board = sorted(tuple(r) for r in res.leaderboard.drop("time_s").collect())
        out.append((board, sorted((r["model"], r["key"], r["fold"], round(r["y"], 9), round(r["prediction"], 6)) for r in res.oof.collect())))
        res.release()
    return out


@pytest.mark.parametrize("task, models, scaler", [
    ("classification", ["Logistic Regression", "Decision Tree", "Naive Bayes", "XGBoost", "LightGBM", "Gradient Boosting", "AdaBoost"], "standard"),
    ("classification", ["Naive Bayes", "K-Nearest Neighbors"], "robust"),
    ("regression", ["XGBoost", "LightGBM", "Gradient Boosting"], "standard"),
    ("regression", ["Ridge", "Decision Tree"], "robust")])
def test_stored_rows_and_cells_give_the_same(spark, monkeypatch, task, models, scaler):
    cached, stored = both(frame(spark)[task == "regression"], task, models, monkeypatch, scaler=scaler)
    assert cached[0] == stored[0]
    assert len(stored[1]) == 1500 * len(models) and cached[1] == stored[1]


def test_forest_over_cells(spark, monkeypatch):
    cached, stored = both(frame(spark)[0], "classification", ["Random Forest"], monkeypatch)
    assert [r[:4] for r in cached[1]] == [r[:4] for r in stored[1]]          # same keys, folds and labels; the draws go by sets
    assert abs(cached[0][0][1] - stored[0][0][1]) < 0.05


def test_large_rows_are_not_cached(spark, monkeypatch):
    """Of all rows nothing is kept in a cache, neither the folded rows nor vectors or predictions of the folds."""
    clf, reg = frame(spark)
    kept = []
    persist = type(clf).persist

    def spied(self, *level):
        kept.append(self)
        return persist(self, *level)

    monkeypatch.setattr(type(clf), "persist", spied)
    monkeypatch.setattr(T, "STORE_FROM", 100)
    for df, task, models in ((clf, "classification", ["Naive Bayes", "Decision Tree"]), (reg, "regression", ["Ridge"])):
        kept.clear()
        T.whole(T.train(df, "target", task, key_cols=["id"], models=models, k=3, refit=False))
        assert all(d.count() < 700 for d in kept)
        kept.clear()
        prep = T.prepare(df, "target", task, key_cols=["id"], k=3)
        assert prep.stored and not kept and prep.n_rows == prep.data.count() == 1500
        assert (prep.cells.agg(F.sum(WEIGHT)).first()[0] == 1500) if task == "classification" else prep.cells is not None


def test_refit_over_cells(spark, monkeypatch):
    monkeypatch.setattr(T, "STORE_FROM", 100)
    df = frame(spark)[0]
    res = T.whole(T.train(df, "target", "classification", key_cols=["id"], models=["Logistic Regression"], k=2, explain=False))
    scored = T.predict(res.pipeline, df, res.labels)
    assert scored.count() == 1500
    monkeypatch.setattr(T, "STORE_FROM", 10 ** 9)
    plain = T.whole(T.train(df, "target", "classification", key_cols=["id"], models=["Logistic Regression"], k=2, explain=False))
    np.testing.assert_allclose(res.pipeline.stages[-1].w, plain.pipeline.stages[-1].w, atol=1e-6)


def test_rows_that_hardly_repeat_make_no_cells(spark):
    df = spark.range(1000).select(F.sin("id").alias("x"), F.lit(0).alias("fold"))
    assert cells(df, ["x", "fold"]) is None
    assert cells(df.select(F.create_map(F.lit(1), F.lit(2)).alias("m"), "fold"), ["m", "fold"]) is None
    few = cells(df.select(F.expr("CASE WHEN x > 0 THEN cast('NaN' AS double) END").alias("x"), "fold", F.col("x").alias("y")), ["x", "fold"], "y").collect()
    assert len(few) == 2 and sum(r[WEIGHT] for r in few) == 1000


def test_statistics_of_weighted_rows(spark):
    df = frame(spark)[1].withColumn("fold", F.col("id") % 3).withColumnRenamed("target", "label")
    few = df.withColumn("label", F.round("label")).drop("id")
    cols = ["a", "b", "c", "d"]
    one, other = (fold_statistics(x, cols, "label", 3, None, scaler="robust", rows=few) for x in (few, few.groupBy(*cols, "label", "fold").agg(F.count("*").alias(WEIGHT))))
    for f in range(3):
        assert (one.n_rows[f], one.nulls[f], one.n_unique[f], one.fills[f], one.quartiles[f]) == (
            other.n_rows[f], other.nulls[f], other.n_unique[f], other.fills[f], other.quartiles[f])
        assert {c: sorted(v) for c, v in one.vocab[f].items()} == {c: sorted(v) for c, v in other.vocab[f].items()}
        for c, m in one.moments[f].items():
            np.testing.assert_allclose([m.n, m.mean, m.m2], [other.moments[f][c].n, other.moments[f][c].mean, other.moments[f][c].m2], rtol=1e-9, atol=1e-9)


def test_products_of_weighted_rows():
    rng = np.random.default_rng(1)
    z, w = rng.normal(size=(50, 3)), rng.integers(1, 5, 50).astype(float)
    one, other = linear.Products.of(np.repeat(z, w.astype(int), axis=0)), linear.Products.of(z, w)
    assert one.n == other.n
    np.testing.assert_allclose(one.mean, other.mean)
    np.testing.assert_allclose(one.scatter, other.scatter)


def test_weighted_forests_need_few_sets(spark, monkeypatch):
    monkeypatch.setattr(T, "STORE_FROM", 100)
    monkeypatch.setattr(forest, "SMALL_ROWS", 10)
    prep = T.prepare(frame(spark)[0], "target", "classification", key_cols=["id"], k=3)
    assert not T._of_cells(prep, "classification", ["Random Forest"], "target") and T._of_cells(prep, "classification", ["AdaBoost"], "target")


def test_narrow_folds_are_the_same(spark):
    """Folds whose rows pass the shuffle without key text and hashes."""
    df = frame(spark)[0]
    wide, narrow = (CV.assign_folds(df, 3, "target", ["id"], 42, narrow_rows=n) for n in (10 ** 9, 0))
    assert sorted((r["id"], r["fold"]) for r in wide.collect()) == sorted((r["id"], r["fold"]) for r in narrow.collect())
    assert narrow.columns == wide.columns
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):]
    assert "AS __h" not in below.split("Aggregate")[0] and "AS __h" in plan


def test_tallies_score_as_rows_do(spark):
    rng = np.random.default_rng(2)
    rows = [("m" if i % 2 else "n", i % 3, float(rng.integers(0, 3)), float(rng.integers(0, 3))) for i in range(300)] + [("m", 0, 1.0, None)]
    oof = spark.createDataFrame(rows, "model string, fold int, y double, prediction double")
    for task in ("classification", "regression"):
        t = CV.tally(oof, task, ["model"])
        assert sorted(map(tuple, CV.tallied_metrics(t, task, ["model"]).collect())) == sorted(map(tuple, CV.evaluate(oof, task, by=["model"]).collect()))
        a, b = ({(r["model"], r["fold"]): r["loss"] for r in x.collect()} for x in (CV.tallied_losses(t, task, ["model"]), CV.fold_losses(oof, task, by=["model"])))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)
