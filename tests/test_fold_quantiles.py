"""Quantiles of all folds at once against a plain quantile of each fold's training rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.functions.quantiles import quantiles_outside_folds
from strata.operators import train as TT
from strata.operators.foldstats import fold_statistics

PROBS = [0.0, 0.25, 0.5, 0.75, 0.99]


def frame(n=4000, k=4):
    rng = np.random.default_rng(5)
    df = pd.DataFrame({"fold": rng.integers(0, k, n), "a": rng.normal(size=n) * 1e3, "b": rng.integers(0, 7, n).astype(float),
                       "hot": np.where(rng.random(n) < 0.4, 2.5, rng.exponential(size=n)), "empty": np.nan})
    df.loc[rng.random(n) < 0.2, "a"] = np.nan
    df["byfold"] = df["fold"] * 1000.0 + rng.random(n)      # values that follow the fold: brackets must widen
    df["only0"] = np.where(df["fold"] == 0, rng.random(n), np.nan)
    return df


def spark_frame(spark, df):
    return spark.createDataFrame(df.astype(object).where(df.notna(), None),
                                 "fold int, " + ", ".join(f"{c} double" for c in df.columns if c != "fold"))


COLS = ["a", "b", "hot", "empty", "byfold", "only0"]


@pytest.mark.parametrize("bracket_rows", [50, 200_000])
def test_equal_to_quantiles_of_each_fold(spark, bracket_rows):
    df = frame()
    got = quantiles_outside_folds(spark_frame(spark, df), COLS, PROBS, "fold", 4, bracket_rows=bracket_rows)
    for f in range(4):
        rows = df[df["fold"] != f]
        for c in COLS:
            v = rows[c].dropna()
            if len(v):
                assert got[f][c] == pytest.approx(np.quantile(v, PROBS).tolist(), rel=1e-12, abs=1e-12), (f, c)
            else:
                assert got[f][c] == [None] * len(PROBS), (f, c)


def test_copies_of_a_fill_count_as_rows(spark):
    df = frame()
    fills = {f: {"a": (12.5, int(df[df["fold"] != f]["a"].isna().sum())), "empty": (0.0, int((df["fold"] != f).sum())),
                 "b": (3.0, 0)} for f in range(4)}
    got = quantiles_outside_folds(spark_frame(spark, df), ["a", "empty", "b"], PROBS, "fold", 4, fills)
    for f in range(4):
        rows = df[df["fold"] != f]
        assert got[f]["a"] == pytest.approx(np.quantile(rows["a"].fillna(12.5), PROBS).tolist(), rel=1e-12)
        assert got[f]["empty"] == [0.0] * len(PROBS)
        assert got[f]["b"] == pytest.approx(np.quantile(rows["b"], PROBS).tolist())


def test_empty_table(spark):
    none = spark.createDataFrame([], "fold int, a double")
    assert quantiles_outside_folds(none, ["a"], [0.5], "fold", 2) == {0: {"a": [None]}, 1: {"a": [None]}}
    assert quantiles_outside_folds(none, [], [0.5], "fold", 2) == {0: {}, 1: {}}


def test_robust_scaler_of_all_folds_equals_a_fit_per_fold(spark):
    rng = np.random.default_rng(8)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n), "x": rng.normal(size=n), "z": rng.exponential(size=n), "target": rng.integers(0, 2, n)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("id") % 6 != 0, F.col("x"))).withColumn(
        "target", F.concat(F.lit("c"), "target"))
    prep = TT.prepare(df, "target", "classification", ["id"], 3, 42)
    passed = ["target", "label", "fold", "__key", "id"]
    fs = fold_statistics(prep.data, ["x", "z"], "label", 3, None, scaler="robust")
    for f in range(3):
        tr, va = prep.data.where(F.col("fold") != f), prep.data.where(F.col("fold") == f)
        a = TT._prepare_fold_shared(tr, va, passed, fs, f, "robust", None, "exact", ["x", "z"])
        b = TT._prepare_fold(tr, va, "target", passed, None, "robust", None, "exact")
        va_a = {r["__key"]: r["features"].toArray() for r in a[1].collect()}
        va_b = {r["__key"]: r["features"].toArray() for r in b[1].collect()}
        assert va_a.keys() == va_b.keys() and all(np.allclose(va_a[k], va_b[k], atol=1e-9) for k in va_a)
    prep.release()
