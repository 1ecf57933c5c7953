"""Queries for cleaning (2.E) and preprocessing (2.F)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strata.functions import stats as S
from strata.operators import clean as C
from strata.operators import prep as PR
from strata.plans.catalog import register, table
from strata.plans.q_profile import CUSTOMER_NULLS_SQL, customer_nulls
from strata.plans.sqlgen import R

# customer with an ID-like, a constant and a mostly-null column (fixed rules)
CLEAN_FRAME_SQL = (
    "(SELECT c_custkey, c_name, c_nationkey, "
    "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, "
    "CASE WHEN c_nationkey < 10 THEN NULL ELSE c_mktsegment END AS c_segment, "
    "1 AS const_one, CASE WHEN c_nationkey < 15 THEN NULL ELSE c_acctbal END AS sparse_bal, "
    "c_mktsegment FROM customer) cf")


def clean_frame(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(~(F.col("c_acctbal") < 0), F.col("c_acctbal")).alias("c_acctbal"),
        F.when(~(F.col("c_nationkey") < 10), F.col("c_mktsegment")).alias("c_segment"),
        F.lit(1).alias("const_one"),
        F.when(~(F.col("c_nationkey") < 15), F.col("c_acctbal")).alias("sparse_bal"),
        "c_mktsegment")


# (column, is_float, is_numeric, is_real_numeric)
_CLEAN_COLS = [("c_custkey", False, True, True), ("c_name", False, False, False),
               ("c_nationkey", False, True, True), ("c_acctbal", True, True, True),
               ("c_segment", False, False, False), ("const_one", False, True, True),
               ("sparse_bal", True, True, True)]


def _clean_sql():
    parts = []
    for c, fl, num, real in _CLEAN_COLS:
        var = f"var_samp(CAST({c} AS DOUBLE))" if num else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS col, count(DISTINCT {c}) AS n_unique, count(*) AS n, "
            f"(count(*) - count({c})) / count(*) AS null_share, {var} AS variance, "
            f"{str(fl).upper()} AS is_float, {str(num).upper()} AS is_numeric, "
            f"{str(real).upper()} AS is_real FROM {CLEAN_FRAME_SQL}")
    return f"""
WITH s AS ({' UNION ALL '.join(parts)}),
f AS (SELECT *, (NOT is_float) AND coalesce(n_unique / n, 0) >= 0.9 AS dc,
        (is_numeric AND coalesce(variance <= 0.0, FALSE)) OR n_unique <= 1 AS dv,
        null_share > 0.5 AS dn FROM s)
SELECT col, CAST(n_unique AS BIGINT) AS n_unique, {R('null_share')} AS null_share,
  {R('variance', 2)} AS variance, dc AS drop_cardinality, dv AS drop_variance, dn AS drop_nulls,
  CASE WHEN dc THEN 'cardinality' WHEN dv THEN 'variance' WHEN dn THEN 'nulls' END AS reason,
  NOT (dc OR dv OR dn) AS kept
FROM f
"""


@register("e_cleaning_report", _clean_sql())
def e_cleaning_report(spark, sf_dir):
    """Cleaning decision per column: ID-like, constant, mostly null."""
    df = clean_frame(spark, sf_dir)
    rep = C.ColumnCleaner(excludeCols=["c_mktsegment"], distinctMode="exact").report(df)
    return rep.select("col", "n_unique", S.rnd(F.col("null_share"), 4).alias("null_share"),
                      S.rnd(F.col("variance"), 2).alias("variance"), "drop_cardinality", "drop_variance",
                      "drop_nulls", "reason", "kept")


@register("e_cleaned_columns", """
SELECT 'c_nationkey' AS col UNION ALL SELECT 'c_acctbal' UNION ALL SELECT 'c_segment' UNION ALL SELECT 'c_mktsegment'
""")
def e_cleaned_columns(spark, sf_dir):
    """Columns left after the fitted cleaner transforms the frame."""
    df = clean_frame(spark, sf_dir)
    model = C.ColumnCleaner(excludeCols=["c_mktsegment"], distinctMode="exact").fit(df)
    out = model.transform(df)
    return spark.createDataFrame([(c,) for c in out.columns], "col string")


@register("f_median_impute", f"""
SELECT c_custkey, {R('coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM ' + CUSTOMER_NULLS_SQL + '))')} AS c_acctbal
FROM {CUSTOMER_NULLS_SQL}
""")
def f_median_impute(spark, sf_dir):
    """Exact-median imputation of ``c_acctbal`` (F1)."""
    df = customer_nulls(spark, sf_dir)
    model = PR.MedianImputer(inputCols=["c_acctbal"], mode="exact").fit(df)
    return model.transform(df).select("c_custkey", S.rnd(F.col("c_acctbal"), 4).alias("c_acctbal"))


def _scaled_sql(center, scale):
    cols = ["c_acctbal", "c_nationkey"]
    sel = []
    for c in cols:
        ce, sc = center(c), scale(c)
        sel.append(f"{R(f'(CAST({c} AS DOUBLE) - ({ce})) / (CASE WHEN ({sc}) = 0 OR ({sc}) IS NULL THEN 1 ELSE ({sc}) END)', 6)} AS {c}")
    return f"SELECT c_custkey, {', '.join(sel)} FROM {CUSTOMER_NULLS_SQL}"


@register("f_standard_scale", _scaled_sql(
    lambda c: f"SELECT avg(CAST({c} AS DOUBLE)) FROM {CUSTOMER_NULLS_SQL}",
    lambda c: f"SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM {CUSTOMER_NULLS_SQL}"))
def f_standard_scale(spark, sf_dir):
    """Standard scaling with the population std, NULLs kept (F2)."""
    df = customer_nulls(spark, sf_dir)
    model = PR.Scaler(inputCols=["c_acctbal", "c_nationkey"], method="standard").fit(df)
    out = model.transform(df)
    return out.select("c_custkey", S.rnd(F.col("c_acctbal"), 6).alias("c_acctbal"),
                      S.rnd(F.col("c_nationkey"), 6).alias("c_nationkey"))


@register("f_robust_scale", _scaled_sql(
    lambda c: f"SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM {CUSTOMER_NULLS_SQL}",
    lambda c: (f"SELECT quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25) "
               f"FROM {CUSTOMER_NULLS_SQL}")))
def f_robust_scale(spark, sf_dir):
    """Robust scaling by median and IQR."""
    df = customer_nulls(spark, sf_dir)
    model = PR.Scaler(inputCols=["c_acctbal", "c_nationkey"], method="robust", mode="exact").fit(df)
    out = model.transform(df)
    return out.select("c_custkey", S.rnd(F.col("c_acctbal"), 6).alias("c_acctbal"),
                      S.rnd(F.col("c_nationkey"), 6).alias("c_nationkey"))


@register("f_onehot", f"""
WITH f AS (SELECT c_custkey, c_nationkey, coalesce(c_segment, 'missing') AS category FROM {CUSTOMER_NULLS_SQL}),
cats AS (SELECT DISTINCT category FROM f WHERE c_nationkey >= 10)
SELECT c_custkey, category,
  CASE WHEN category IN (SELECT category FROM cats)
       THEN CAST((SELECT count(*) FROM cats c2 WHERE c2.category < f.category) AS INTEGER) END AS slot
FROM f
""")
def f_onehot(spark, sf_dir):
    """One-hot slots fitted on part of the rows; unseen values -> zero vector."""
    df = customer_nulls(spark, sf_dir)
    fit_rows = df.where(F.col("c_nationkey") >= 10)
    stages = [PR.CategoricalFill(inputCols=["c_segment"]),
              PR.CategoryIndexer(inputCols=["c_segment"], outputCols=["seg_idx"]),
              PR.OneHotEncoder(inputCols=["seg_idx"], outputCols=["seg_ohe"], dropLast=True)]
    model = Pipeline(stages=stages).fit(fit_rows)
    out = model.transform(df)
    arr = vector_to_array("seg_ohe")
    pos = F.array_position(arr, 1.0)
    return out.select("c_custkey", F.col("c_segment").alias("category"),
                      F.when(pos > 0, (pos - 1).cast("int")).alias("slot"))


@register("f_label_codes", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label
FROM orders
""")
def f_label_codes(spark, sf_dir):
    """Alphabetical label codes of a categorical target."""
    df = table(spark, sf_dir, "orders")
    model = PR.label_indexer("o_orderpriority").fit(df)
    return model.transform(df).select("o_orderkey", "label")
