"""Feature catalogue, feature step and validation."""

import math

import pandas as pd
from pyspark.sql import functions as F

from strata.functions import features as FE
from strata.operators import search as K


def _frame(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, 100.0], "b": [0.0, 1.0, 2.0, 2.0, 4.0],
                        "c": [0, 1, 2, 3, 4], "t": ["Mr. A", "Mrs. B", "x", "Dr. C", None]})
    return spark.createDataFrame(pdf)


def test_ratio_with_zero_denominator_and_logs(spark):
    df = _frame(spark)
    out = FE.apply_features([FE.Ratio("r", "a", "b"), FE.Log1p("l", "a"), FE.Log2Floor("l2", "b")], df)
    rows = out.orderBy("a").collect()
    assert math.isclose(rows[0]["r"], 1.0 / 1e-9)
    assert math.isclose(rows[1]["l"], math.log1p(2.0))
    assert rows[0]["l2"] == 0.0


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double")
    out = FE.apply_features([FE.Clip("y", "x", 0, 1)], df)
    assert sorted((r["y"] for r in out.collect()), key=lambda v: (v is None, v)) == [0.0, 1.0, None]


def test_regex_no_match_is_null(spark):
    df = _frame(spark)
    out = FE.apply_features([FE.RegexText("title", "t", r"^(\w+)\."), FE.RegexNumber("n", "t", r"(\d+)")], df)
    got = {r["t"]: r["title"] for r in out.collect()}
    assert got["Mr. A"] == "Mr" and got["x"] is None and got[None] is None
    assert all(r["n"] is None for r in out.collect())


def test_pct_rank_matches_pandas(spark):
    vals = [3.0, 1.0, 3.0, 2.0, None, 5.0, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    out = {r["i"]: r["p"] for r in FE.apply_features([FE.PctRank("p", "x")], df).collect()}
    exp = pd.Series(vals).rank(pct=True)
    for i, v in enumerate(exp):
        if pd.isna(v):
            assert out[i] is None
        else:
            assert math.isclose(out[i], v)


def test_inf_becomes_null(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    out = FE.apply_features([FE.Expr("y", "exp(x + 1000.0) * (2 * x - 1)")], df)
    assert all(r["y"] is None for r in out.collect())


def test_train_scope_statistics(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    other = spark.createDataFrame([(5.0,)], "x double")
    fitted = FE.fit_features([FE.ZScore("z", "x", eps=0.0)], train)
    z = fitted.transform(other).first()["z"]
    assert math.isclose(z, (5.0 - 2.0) / math.sqrt(2.0))


def test_group_agg_unseen_group_null(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "g string, x double")
    other = spark.createDataFrame([("a",), ("c",)], "g string")
    fitted = FE.fit_features([FE.GroupAgg("m", "g", "x")], train)
    got = {r["g"]: r["m"] for r in fitted.transform(other).collect()}
    assert got == {"a": 2.0, "c": None}


def test_feature_step_failure_leaves_frame(spark):
    df = _frame(spark)
    model = FE.FeatureStep([FE.Expr("x", "missing_col + 1")]).fit(df)
    assert model.transform(df).columns == df.columns
    assert model.error is not None


def test_validation_kinds(spark):
    df = _frame(spark)
    assert K.validate_step([FE.Expr("z", "a + b")], df)["kind"] is None
    assert K.validate_step([FE.FrameFunction("f", lambda d: d.limit(2))], df)["kind"] == "row_count"
    assert K.validate_step([FE.FrameFunction("f", lambda d: d.select())], df)["kind"] == "no_columns"
    assert K.validate_step([FE.FrameFunction("f", lambda d: d.where(F.lit(False)))], df)["kind"] == "empty"
    assert K.validate_step([FE.Expr("z", "nope")], df)["kind"] == "exception"
