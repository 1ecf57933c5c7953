"""Folds, strata and metrics: invariants and known answers."""

import math

import pytest
from pyspark.sql import functions as F

from strata.operators import cv as CV


def test_accuracy_and_weighted_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "a"), ("b", "a")], "y string, prediction string")
    r = CV.classification_metrics(df).first()
    assert r["accuracy"] == 0.75
    # class a: p=2/3 r=1; class b: p=1 r=1/2 -> weighted
    assert r["precision"] == round(0.5 * 2 / 3 + 0.5 * 1, 4)
    assert r["recall"] == 0.75


def test_rmse(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.0), (4.0, 3.8)], "y double, prediction double")
    r = CV.regression_metrics(df).first()
    assert r["rmse"] == round(math.sqrt(0.06 / 4), 4)


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b")], "y string, prediction string")
    r = CV.classification_metrics(df).first()
    assert r["precision"] == 0.0 and r["f1"] == 0.0


def test_folds_balanced_per_class(spark):
    rows = [(i, "x" if i % 10 < 7 else "y") for i in range(1003)]
    df = spark.createDataFrame(rows, "id long, c string")
    f = CV.assign_folds(df, 5, "c", ["id"], 42)
    sizes = f.groupBy("c", "fold").count().collect()
    for cls in ("x", "y"):
        ns = [r["count"] for r in sizes if r["c"] == cls]
        assert len(ns) == 5 and max(ns) - min(ns) <= 1
    assert f.count() == 1003 and f.select("id").distinct().count() == 1003


def test_folds_deterministic(spark):
    df = spark.range(200).withColumn("c", (F.col("id") % 3).cast("string"))
    a = {r["id"]: r["fold"] for r in CV.assign_folds(df, 4, "c", ["id"], 7).collect()}
    b = {r["id"]: r["fold"] for r in CV.assign_folds(df.repartition(5), 4, "c", ["id"], 7).collect()}
    assert a == b


def test_too_many_folds_raises(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, c string")
    with pytest.raises(ValueError):
        CV.assign_folds(df, 5, "c", ["id"], 42)


def test_regression_strata_fallbacks(spark):
    const = spark.createDataFrame([(i, 5.0) for i in range(20)], "id int, y double")
    s = CV.regression_strata(const, "y", 5, key_cols=["id"])
    assert set(r["stratum"] for r in s.collect()) <= {0, 1}
    two = spark.createDataFrame([(i, float(i % 2)) for i in range(20)], "id int, y double")
    s2 = CV.regression_strata(two, "y", 5)
    assert sorted(set(r["stratum"] for r in s2.collect())) == [0, 1]


def test_leaderboard_groups_models(spark):
    rows = [("m1", 1, 0, "a", "a"), ("m1", 2, 1, "b", "a"), ("m2", 1, 0, "a", "a"), ("m2", 2, 1, "b", "b")]
    oof = spark.createDataFrame(rows, "model string, key int, fold int, y string, prediction string")
    board = {r["model"]: r for r in CV.leaderboard(oof, "classification").collect()}
    assert board["m2"]["cv_loss_mean"] == 0.0 and board["m1"]["cv_loss_mean"] == 0.5
    assert CV.best_model(CV.leaderboard(oof, "classification")).first()["model"] == "m2"


def test_hot_copies_path_balanced_and_equal_for_unique_keys(spark):
    # a third of the rows are copies of one row, no key given
    rows = [(1, "x", 0.5)] * 400 + [(i, "x" if i % 3 else "y", float(i)) for i in range(800)]
    df = spark.createDataFrame(rows, "a long, c string, v double")
    f = CV.assign_folds(df, 5, "c", None, 42, hot_bucket_rows=50)
    assert f.count() == 1200
    sizes = f.groupBy("c", "fold").count().collect()
    for cls in ("x", "y"):
        ns = [r["count"] for r in sizes if r["c"] == cls]
        assert max(ns) - min(ns) <= 1
    copies = f.where("a = 1 AND v = 0.5").groupBy("fold").count().collect()
    assert max(r["count"] for r in copies) - min(r["count"] for r in copies) <= 1
    # with unique keys the tie path numbers rows exactly like the plain path
    u = spark.range(500).withColumn("c", (F.col("id") % 4).cast("string"))
    plain = {r["id"]: r["fold"] for r in CV.assign_folds(u, 5, "c", ["id"], 7).collect()}
    tie = {r["id"]: r["fold"] for r in CV.assign_folds(u, 5, "c", ["id"], 7, hot_bucket_rows=0).collect()}
    assert plain == tie
