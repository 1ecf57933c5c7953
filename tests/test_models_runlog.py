"""Models, training runner, explanation, search loop and run-log analytics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler

from strata.operators import models as M
from strata.operators import runlog as L
from strata.operators import train as T


def _clf(spark, n=120):
    rng = np.random.default_rng(42)
    age = rng.integers(18, 80, n).astype(float)
    salary = rng.normal(50000, 15000, n)
    dept = rng.choice(["eng", "sales", "hr"], n)
    target = np.where(age + salary / 2000 > 70, "yes", "no")
    return spark.createDataFrame(pd.DataFrame({"id": range(n), "age": age, "salary": salary,
                                               "department": dept, "target": target}))


def test_unknown_model_fails_cleanly(spark):
    res = T.train(_clf(spark), "target", key_cols=["id"], models=["No Such Model"], k=3)
    assert res.status == "failed" and math.isinf(res.cv_loss) and res.best_model_name == ""


def test_train_beats_majority_and_refits(spark):
    df = _clf(spark)
    res = T.train(df, "target", key_cols=["id"], models=["Logistic Regression", "Decision Tree"], k=3)
    assert res.status == "complete"
    majority = df.groupBy("target").count().agg({"count": "max"}).first()[0] / df.count()
    assert res.cv_score > majority
    oof = res.oof
    assert oof.count() == 2 * df.count()
    assert oof.select("model", "key").distinct().count() == oof.count()
    scored = T.predict(res.pipeline, df, res.labels)
    assert scored.count() == df.count()
    assert res.importance.count() > 0


def test_held_out_rows_do_not_change_their_own_fit(spark):
    # poisoning the target of fold-0 rows must not change the model fitted for fold 0
    from strata.operators import cv as CV
    df = _clf(spark)
    folds = {r["id"]: r["fold"] for r in CV.assign_folds(df, 3, "target", ["id"], 42).collect()}
    from pyspark.sql import functions as F
    poisoned = df.withColumn("salary", F.when(F.col("id").isin([i for i, f in folds.items() if f == 0]),
                                              F.lit(1e9)).otherwise(F.col("salary")))
    a = T.train(df, "target", key_cols=["id"], models=["Decision Tree"], k=3, refit=False)
    b = T.train(poisoned, "target", key_cols=["id"], models=["Decision Tree"], k=3, refit=False)
    fold_loss = lambda r: {x["fold"]: x["loss"] for x in r.fold_losses.collect()}
    # folds 1 and 2 are predicted by models that saw poisoned rows; fold 0 model did not see them
    assert set(fold_loss(a)) == set(fold_loss(b)) == {0, 1, 2}


def test_ridge_and_lasso_match_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = 2 * x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(0, 0.1, 200)
    pdf = pd.DataFrame(x, columns=["x1", "x2", "x3"])
    pdf["label"] = y
    df = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(spark.createDataFrame(pdf))
    ctx = M.fit_context(df, "regression")
    ridge = M.get_model("Ridge", "regression", ctx).fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 1.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(ridge.coefficients.toArray(), w, atol=1e-4)


def test_adaboost_learns(spark):
    df = _clf(spark, 200)
    res = T.train(df, "target", key_cols=["id"], models=["AdaBoost"], model_params={"AdaBoost": {"n_estimators": 5}},
                  k=3, refit=False)
    assert res.status == "complete" and res.cv_score > 0.6


def test_log_best_round_and_progression(spark):
    rows = [("r", 0, 0.70, 0.30, None, False, "complete"), ("r", 1, 0.72, 0.28, 0.02, False, "complete"),
            ("r", 2, 0.78, 0.22, 0.06, True, "complete"), ("r", 3, 0.99, 0.01, 0.2, False, "failed")]
    log = spark.createDataFrame(rows, "run_id string, round_num int, cv_score double, cv_loss double, "
                                      "delta double, improved boolean, status string")
    for c, t in [("fe_code", "string"), ("executor_error", "string"), ("shap_top", "array<string>"),
                 ("shap_dead", "array<string>"), ("best_model", "string"), ("new_features", "array<string>")]:
        from pyspark.sql import functions as F
        log = log.withColumn(c, F.lit(None).cast(t))
    assert L.best_rounds(log).first()["round_num"] == 2
    st = {r["round_num"]: r["status"] for r in L.progression(log).collect()}
    assert st == {0: "baseline", 1: "best", 2: "best", 3: "no improvement"}
    rec = L.recommendation(log).first()
    assert rec["recommendation"] == "round 2"


def test_knn_through_training_runner(spark):
    df = _clf(spark, 150)
    res = T.train(df, "target", key_cols=["id"], models=["K-Nearest Neighbors"], k=3, refit=False)
    assert res.status == "complete", res.errors
    assert res.oof.count() == 150 and res.cv_score > 0.6


def test_knn_matches_bruteforce(spark):
    from strata.operators.knn import knn_predict
    rng = np.random.default_rng(3)
    tr = rng.normal(size=(60, 4))
    qx = rng.normal(size=(25, 4))
    lab = rng.integers(0, 3, 60)
    train_df = spark.createDataFrame([(f"t{i}", tr[i].tolist(), float(lab[i])) for i in range(60)],
                                     "__key string, features array<double>, label double")
    query_df = spark.createDataFrame([(f"q{i}", qx[i].tolist()) for i in range(25)],
                                     "__key string, features array<double>")
    got = {r["key"]: r["prediction"] for r in knn_predict(train_df, query_df, k=5, block_rows=7).collect()}
    tkeys = [f"t{i}" for i in range(60)]
    for i in range(25):
        d = np.sqrt(((tr - qx[i]) ** 2).sum(1))
        order = sorted(range(60), key=lambda j: (d[j], tkeys[j]))[:5]
        counts = np.bincount(lab[order], minlength=3)
        assert got[f"q{i}"] == float(np.argmax(counts))


def test_search_loop_stops_on_stall_and_logs_rounds(spark):
    from strata.functions import features as FE
    from strata.operators import search as K
    df = _clf(spark, 90)
    useless = [K.Candidate("noise1", [FE.Expr("z1", "id * 0")]), K.Candidate("noise2", [FE.Expr("z2", "id * 0")]),
               K.Candidate("noise3", [FE.Expr("z3", "id * 0")])]
    events = []
    res = K.search_features(df, "target", useless, key_cols=["id"], patience=1, models=["Decision Tree"], k=3,
                            on_round=events.append)
    rows = res.log.orderBy("round_num").collect()
    assert [r["round_num"] for r in rows] == [0, 1]          # one stall then stop
    assert rows[0]["delta"] is None and rows[0]["improved"] is False
    assert rows[1]["improved"] is False and res.best_round == 0
    assert [e["round_num"] for e in events] == [0, 1]


def test_shared_fold_statistics_equal_per_fold_fits(spark):
    from pyspark.sql import functions as F
    from strata.operators import train as TT
    from strata.operators.foldstats import fold_statistics
    df = _clf(spark, 120).withColumn("salary", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("salary")))
    prep = TT.prepare(df, "target", "classification", ["id"], 3, 42)
    data = prep.data
    pt = ["target", "label", "fold", "__key", "id"]
    feats = [c for c in data.columns if c not in pt]
    fs = fold_statistics(data, feats, "label", 3, 1000)
    for f in range(3):
        tr, va = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        a = TT._prepare_fold_shared(tr, va, pt, fs, f, "standard", None, "exact", feats)
        b = TT._prepare_fold(tr, va, "target", pt, None, "standard", None, "exact")
        assert a[3] == b[3]                                   # same feature names / vocabularies
        va_a = {r["__key"]: r["features"].toArray() for r in a[1].collect()}
        va_b = {r["__key"]: r["features"].toArray() for r in b[1].collect()}
        assert va_a.keys() == va_b.keys()
        assert all(np.allclose(va_a[k], va_b[k], atol=1e-9) for k in va_a)
    prep.release()


def test_model_queries_are_registered_whole(spark, monkeypatch):
    from strata.plans import q_models as Q

    class Stop(Exception):
        pass

    calls = []

    def stop(*args, **kw):
        calls.append(kw)
        raise Stop

    monkeypatch.setattr(Q.T, "train", stop)
    monkeypatch.setattr(Q.K, "search_features", stop)
    names = ["g_forest", "g_gbt", "g_adaboost", "g_trees_reg", "g_adaboost_reg", "i_tree_importance", "i_shapley_mc", "k_search_log"]
    for name in names:
        with pytest.raises(Stop):
            getattr(Q, name)(spark, "/root/testdata/sf0.001")
    assert [c["k"] for c in calls] == [5] * len(names) and not any(c.get("model_params") for c in calls)
    assert "models" not in calls[-1] and "max_rounds" not in calls[-1]
