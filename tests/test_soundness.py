"""Search, reading, saving, folds and quantiles on the cases that once went wrong."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from strata.functions import features as FE
from strata.functions.quantiles import exact_quantiles
from strata.operators import cv as CV
from strata.operators import knn as KN
from strata.operators import models as M
from strata.operators import prep as PR
from strata.operators import search as K
from strata.operators import train as T
from strata.sources import readers as RD
from strata.sources import sinks as SK


def frame(spark, n=90):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=n), rng.normal(size=n)
    return spark.createDataFrame(pd.DataFrame({"id": range(n), "x": x, "z": z, "g": rng.choice(["a", "b", "c"], n),
                                               "target": np.where(x + 0.3 * z > 0, "yes", "no")}))


CASES = {
    "drops rows": [FE.FrameFunction("f", lambda d: d.where(F.col("x") > 0))],
    "reads the label": [FE.FrameFunction("f", lambda d: d.withColumn("leak", F.col("label")))],
    "names the label": [FE.Expr("leak", "label * 2")],
    "overwrites the target": [FE.Expr("target", "x")],
    "reads the fold": [FE.Expr("leak", "fold + 0.5")],
    "fails at run time": [FE.Expr("bad", "raise_error('no')")],
    "drops the key": [FE.FrameFunction("f", lambda d: d.drop("__row").limit(5))],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_invalid_steps_leave_features_unchanged(spark, case):
    df = frame(spark)
    kwargs = dict(key_cols=["id"], models=["Decision Tree"], k=3, refit=False)
    base = T.train(df, "target", "classification", **kwargs)
    res = T.train(df, "target", "classification", fe_step=FE.FeatureStep(CASES[case]), **kwargs)
    assert res.fe_error and res.status == "complete"
    assert res.cv_loss == base.cv_loss
    assert res.oof.select("key").distinct().count() == df.count()


def test_search_rejects_invalid_candidates(spark):
    df = frame(spark)
    cands = [K.Candidate(n, f) for n, f in sorted(CASES.items())] + [K.Candidate("sum", [FE.Expr("s", "x + 0.3 * z")])]
    res = K.search_features(df, "target", cands, task_type="classification", key_cols=["id"], max_rounds=len(cands),
                            patience=len(cands), models=["Decision Tree"], k=3)
    rows = res.log.orderBy("round_num").collect()
    assert len(rows) == len(cands) + 1
    assert not any(r["improved"] for r in rows[1:-1]) and all(r["executor_error"] for r in rows[1:-1])
    assert rows[-1]["executor_error"] is None
    assert res.final.oof.select("key").distinct().count() == df.count()


def test_good_frame_function_sees_features_only(spark):
    df, seen = frame(spark), []

    def fn(d):
        seen.append(set(d.columns))
        return d.withColumn("s", F.col("x") + F.col("z"))

    res = T.train(df, "target", "classification", key_cols=["id"], models=["Decision Tree"], k=3,
                  fe_step=FE.FeatureStep([FE.FrameFunction("s", fn)]))
    assert res.fe_error is None and not any(c & {"target", "label", "fold", "__key", "id"} for c in seen)
    assert "num__s" in res.feature_names
    assert T.predict(res.pipeline, df.drop("target"), res.labels).count() == df.count()


def test_preparation_failure_skips_the_models(spark):
    df = frame(spark).withColumn("bad", F.expr("CASE WHEN id = 7 THEN array('x') END"))
    res = T.train(df, "target", "classification", key_cols=["id"], models=["Decision Tree"], k=3, refit=False,
                  scaler="no such scaler")
    assert res.status == "failed" and "no such scaler" in res.errors["Decision Tree"]


def test_held_out_rows_do_not_touch_their_own_fit(spark):
    df = frame(spark)
    folds = {r["id"]: r["fold"] for r in CV.assign_folds(df, 3, "target", ["id"], 42).collect()}
    held = [i for i, f in folds.items() if f == 0]
    poisoned = df.withColumn("z", F.when(F.col("id").isin(held), F.lit(1e6)).otherwise(F.col("z")))
    kwargs = dict(key_cols=["id"], models=["Logistic Regression"], k=3, refit=False)
    # fold 0 learns from the other folds only, so its answers to unpoisoned columns don't move
    a = T.train(df.withColumn("z", F.when(F.col("id").isin(held), F.lit(0.0)).otherwise(F.col("z"))), "target", **kwargs)
    b = T.train(poisoned.withColumn("z", F.when(F.col("id").isin(held), F.lit(0.0)).otherwise(F.col("z"))), "target", **kwargs)
    pick = lambda r: sorted((x["key"], x["prediction"]) for x in r.oof.where("fold = 0").collect())
    assert pick(a) == pick(b)
    c = T.train(poisoned, "target", **kwargs)
    others = lambda r: sorted((x["key"], x["prediction"]) for x in r.oof.where("fold <> 0").collect())
    assert others(c) != others(a)  # the other folds did learn from the poisoned rows


def test_best_model_by_full_precision(spark):
    df = frame(spark)
    res = T.train(df, "target", "classification", key_cols=["id"], models=["Decision Tree", "Logistic Regression"], k=3, refit=False)
    loss = {m: g["loss"].mean() for m, g in res.fold_losses.toPandas().groupby("model")}
    assert res.best_model_name == min(loss, key=lambda m: (loss[m], m))


def test_keys_without_key_columns_are_unique(spark):
    df = frame(spark, 30).drop("id")
    res = T.train(df.union(df), "target", "classification", models=["Decision Tree"], k=3, refit=False)
    assert res.oof.count() == 60 and res.oof.select("key").distinct().count() == 60


def test_null_strata_and_hot_keys_keep_every_row(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("s"), F.lit("same").alias("k"))
    out = CV.assign_folds(df, 5, "s", ["id"], 1)
    assert out.count() == 300
    sizes = out.groupBy("s", "fold").count().groupBy("s").agg((F.max("count") - F.min("count")).alias("d"))
    assert sizes.agg(F.max("d")).first()[0] <= 1
    tied = CV.assign_folds(df.select("s", "k"), 5, "s", ["k"], 1, hot_bucket_rows=10)
    assert tied.count() == 300 and tied.columns == ["s", "k", "fold"]
    sizes = tied.groupBy("s", "fold").count().groupBy("s").agg((F.max("count") - F.min("count")).alias("d"))
    assert sizes.agg(F.max("d")).first()[0] <= 1


def test_csv_reads_ordinary_files(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('sepal.length,answer,code,"full name",note,flag,blank\n'
                 '5.1,yes,1d,"Smith, Mr. ""Bob"" X","two\nlines",True, \n'
                 '4.9,no,2d,"Doe",plain,FALSE,x\n')
    df = RD.read_csv(spark, str(p))
    assert dict(df.dtypes) == {"sepal.length": "double", "answer": "string", "code": "string", "full name": "string",
                               "note": "string", "flag": "boolean", "blank": "string"}
    rows = df.collect()
    assert len(rows) == 2
    assert rows[0]["full name"] == 'Smith, Mr. "Bob" X' and rows[0]["note"] == "two\nlines" and rows[0]["blank"] == " "
    assert [r["answer"] for r in rows] == ["yes", "no"] and [r["flag"] for r in rows] == [True, False]
    assert RD.canonical_nulls(df).columns == df.columns


def test_saved_stages_transform_alike(spark, tmp_path):
    df = frame(spark)
    step = FE.FeatureStep([FE.ZScore("zx", "x"), FE.GroupAgg("mx", "g", "x", "mean"), FE.Expr("s", "x + z")]).fit(df.drop("target"))
    cols = ["id", "zx", "mx", "s"]
    SK.save_pipeline(PipelineModel(stages=[step]), str(tmp_path / "step"))
    back = SK.load_pipeline(str(tmp_path / "step"))
    rows = lambda m: sorted(map(tuple, m.transform(df).select(*cols).collect()))
    assert rows(step) == rows(back)
    vec = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(
        df.withColumn("label", (F.col("target") == "yes").cast("double")).withColumn("__key", F.col("id").cast("string")))
    for name, model in (("ada", M.AdaBoostClassifier(n_estimators=4).fit(vec)), ("adareg", M.AdaBoostRegressor(n_estimators=3).fit(vec)),
                        ("knn", KN.KNNClassifier(3).fit(vec))):
        SK.save_pipeline(PipelineModel(stages=[model]), str(tmp_path / name))
        back = SK.load_pipeline(str(tmp_path / name))
        pick = lambda m: sorted((r["id"], r["prediction"]) for r in m.transform(vec).select("id", "prediction").collect())
        assert pick(model) == pick(back), name


def test_knn_scores_rows_without_a_key(spark):
    df = frame(spark)
    res = T.train(df, "target", "classification", key_cols=["id"], models=["K-Nearest Neighbors"], k=3)
    assert res.status == "complete", res.errors
    new = df.select("x", "z", "g")
    scored = T.predict(res.pipeline, new, res.labels)
    assert scored.count() == new.count() and scored.where("prediction is null").count() == 0


def test_knn_full_cell_is_bounded_and_exact():
    import resource

    rng = np.random.default_rng(0)
    q, t = rng.normal(size=(600, 64)), rng.normal(size=(20_000, 64))
    t[:50] = t[50:100]  # ties
    qd = pd.DataFrame({"key": [f"q{i}" for i in range(len(q))], "x": list(q), "label": 0.0})
    td = pd.DataFrame({"key": [f"{i:05d}" for i in range(len(t))], "x": list(t), "label": 1.0})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = KN._cell_topk(5)(qd, td)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB
    for i in (0, 7, 599):
        d = np.sqrt(((q[i] - t) ** 2).sum(axis=1))
        want = [f"{j:05d}" for j in np.argsort(d, kind="stable")[:5]]
        assert out[out.qkey == f"q{i}"].tkey.tolist() == want


def test_quantiles_of_repeated_values_stay_small(spark):
    # eleven values, two of which hold most rows: one counted row each, however often they occur
    df = spark.range(100_000).select((F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id") % 11).otherwise(5) / 100.0).alias("v"))
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["v"], probs, bracket_rows=50)["v"]
    assert got == pytest.approx(list(df.agg(F.percentile("v", probs)).first()[0]), abs=1e-12)


def test_every_category_is_encoded(spark):
    df = spark.range(1500).select((F.col("id") * 1.0).alias("x"), F.concat(F.lit("c"), F.col("id") % 1200).alias("c"))
    model = PR.fit_preprocessor(df, [], ["c"])
    assert len(PR.feature_names(model)) == 1200
    from pyspark.ml.functions import vector_to_array
    ones = model.transform(df).select(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, v: a + v).alias("n"))
    assert ones.where("n <> 1").count() == 0


def test_candidates_rank_by_class_separation_and_skip_dropped_columns(spark):
    rng = np.random.default_rng(1)
    n = 200
    y = rng.integers(0, 2, n)
    df = spark.createDataFrame(pd.DataFrame({
        "wide": rng.normal(size=n) * 1e6, "signal": y + rng.normal(size=n) * 0.1, "other": y + rng.normal(size=n),
        "constant": 1.0, "target": np.where(y, "yes", "no")}))
    sep = K.class_separation(df, "target", ["wide", "signal"])
    assert sep["signal"] > 0.9 > 0.1 > sep["wide"]
    assert "constant" not in K.surviving_columns(df, "target")
    assert K.auto_candidates(df, "target")[0].name == "ratio_signal_other"
    assert K.one_hot_names(df.withColumn("g", F.lit("v")), ["g"], {"g_v", "g_w"}) == {"g_v"}
