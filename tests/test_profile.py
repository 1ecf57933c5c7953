"""Task detection, profile statistics and warnings on small known-answer fixtures."""

import numpy as np
import pandas as pd

from strata.operators import profile as P


def _detect(spark, values, dtype=None):
    pdf = pd.DataFrame({"y": values})
    df = spark.createDataFrame(pdf) if dtype is None else spark.createDataFrame([(v,) for v in values], f"y {dtype}")
    r = P.detect_task(df, "y").first()
    return r["task_type"], r["confidence"]


def test_strings_are_classification(spark):
    assert _detect(spark, ["yes", "no"] * 100)[0] == "classification"


def test_binary_ints_high_confidence(spark):
    task, conf = _detect(spark, [0, 1, 0, 1, 1, 0] * 30)
    assert task == "classification" and conf > 0.8


def test_booleans(spark):
    task, conf = _detect(spark, [True, False] * 50, "boolean")
    assert task == "classification" and conf > 0.9


def test_gaussian_is_regression(spark):
    rng = np.random.default_rng(42)
    task, conf = _detect(spark, list(rng.normal(100, 20, 500)))
    assert task == "regression" and conf > 0.7


def test_sequence_is_regression(spark):
    assert _detect(spark, list(range(500)), "bigint")[0] == "regression"


def test_all_null_target_follows_the_rules(spark):
    # empty set is a subset of {0,1} (0.99) and 0 uniques <= 20 (0.80): mean 0.895
    task, conf = _detect(spark, [None, None, None], "double")
    assert task == "classification" and abs(conf - 0.895) < 1e-9


def test_column_profile_values(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 3.0, 4.0, 10.0, None], "c": ["a", "a", "b", None, "c", "a"],
                        "t": [0, 1, 0, 1, 0, 1]})
    df = spark.createDataFrame(pdf)
    from strata.sources.readers import canonical_nulls
    rows = {r["col"]: r for r in P.column_profile(canonical_nulls(df), target="t").collect()}
    x = pdf["x"]
    assert rows["x"]["null_count"] == 1
    assert rows["x"]["mean"] == round(x.mean(), 4)
    assert rows["x"]["std"] == round(x.std(), 4)
    assert rows["x"]["median"] == round(x.median(), 4)
    assert abs(rows["x"]["skew"] - x.skew()) < 1e-4
    assert rows["c"]["cardinality"] == 3 and rows["c"]["cardinality_rate"] == round(3 / 6, 4)
    assert rows["c"]["mean"] is None


def test_constant_column_skew_is_zero(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0)], "x double, t int")
    r = P.column_profile(df, target="t").first()
    assert r["skew"] == 0.0


def test_top_values_excludes_nulls_and_ranks(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    rows = P.top_values(df, ["c"], 5).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in rows] == [("a", 2), ("b", 1)]


def test_imbalanced_target_and_warnings(spark):
    rows = [("yes", f"u{i}", None if i % 2 else 1.0) for i in range(180)] + \
           [("no", f"v{i}", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "target string, id_col string, sparse double")
    ts = P.target_stats(df, "target", "classification").first()
    assert ts["imbalance_ratio"] == 9.0 and ts["is_imbalanced"]
    cp = P.column_profile(df, target="target")
    kinds = sorted(r["kind"] for r in P.build_warnings(cp, "target", P.target_stats(df, "target", "classification")).collect())
    assert kinds == ["id_like", "imbalanced", "missing"]


def test_missing_target_raises(spark):
    import pytest
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="not found"):
        P.profile(df, "target")
