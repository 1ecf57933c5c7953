"""EDA tables on small frames with known answers."""

import math

import pandas as pd

from strata.operators import eda as E


def test_corr_constant_and_partially_constant(spark):
    rows = [(1.0, 1.0, 5.0), (1.0, 2.0, 1.0), (1.0, 3.0, 2.0), (None, 4.0, 3.0), (2.0, None, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in E.correlation_matrix(df, ["a", "b", "c"], 4).collect()}
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"])
    ref = pdf.corr()
    for (x, y), v in got.items():
        e = ref.loc[x, y]
        assert (v is None and (pd.isna(e))) or math.isclose(v, round(e, 4), abs_tol=1e-4), (x, y, v, e)


def test_histograms_match_numpy_and_pandas(spark):
    import numpy as np
    vals = [0.0, 1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    left = [r["n"] for r in E.histogram(df, "x", bins=5, closed="left").orderBy("bin").collect()]
    assert left == list(np.histogram(vals, bins=5)[0]) == [2, 2, 1, 0, 1]
    right = [r["n"] for r in E.histogram(df, "x", bins=5, closed="right").orderBy("bin").collect()]
    assert right == list(pd.Series(vals).value_counts(bins=5, sort=False).values) == [3, 2, 0, 0, 1]


def test_duplicates_group_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "k int, v string")
    assert E.duplicate_rows(df).first()["duplicate_rows"] == 3
