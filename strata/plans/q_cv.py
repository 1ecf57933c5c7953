"""Queries for folds, strata and out-of-fold metrics (2.H).

The metric queries score stand-in predictions: fixed rules over the same
``orders`` / ``lineitem`` rows give (key, fold, y, prediction) tables of the
expected schema; folds come from the library's fold assignment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strata.functions import stats as S
from strata.functions.quantiles import quantiles_outside_folds
from strata.operators import cv as CV
from strata.plans.catalog import register, table
from strata.plans.sqlgen import R

FOLDS_SQL = ("SELECT *, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY "
             "md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), CAST(o_orderkey AS VARCHAR)) - 1) % 5 "
             "AS INTEGER) AS fold FROM orders")


def order_folds(spark, sf_dir):
    return CV.assign_folds(table(spark, sf_dir, "orders"), k=5, strata_col="o_orderstatus",
                           key_cols=["o_orderkey"], seed=42)


@register("h_stratified_folds", f"SELECT o_orderkey, o_orderstatus, fold FROM ({FOLDS_SQL})")
def h_stratified_folds(spark, sf_dir):
    """Stratified, seeded 5-fold assignment of ``orders`` by ``o_orderstatus`` (H1)."""
    return order_folds(spark, sf_dir).select("o_orderkey", "o_orderstatus", "fold")


@register("h_regression_strata", """
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice,
             [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM orders)
SELECT o_orderkey, CAST(len(list_filter(edges[2:len(edges) - 1], lambda x: x < o_totalprice)) AS INTEGER) AS stratum
FROM orders, e
""")
def h_regression_strata(spark, sf_dir):
    """Quantile strata (10 bins, right-closed) of ``o_totalprice`` (H2)."""
    o = table(spark, sf_dir, "orders")
    return CV.regression_strata(o, "o_totalprice", k=5, exact=True).select("o_orderkey", "stratum")


@register("h_fold_quartiles", f"""
WITH f AS (SELECT fold, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_totalprice AS DOUBLE) END AS price,
                  CAST(o_custkey AS DOUBLE) AS customer FROM ({FOLDS_SQL})),
k AS (SELECT DISTINCT fold AS held_out FROM f),
m AS (SELECT held_out, quantile_cont(price, 0.5) AS fill FROM k JOIN f ON fold <> held_out GROUP BY held_out),
v AS (SELECT held_out, 'price' AS col, coalesce(price, fill) AS x FROM m JOIN f ON fold <> held_out
      UNION ALL SELECT held_out, 'customer', customer FROM k JOIN f ON fold <> held_out)
SELECT held_out, col, {R('quantile_cont(x, 0.25)', 4)} AS q1, {R('quantile_cont(x, 0.5)', 4)} AS median,
       {R('quantile_cont(x, 0.75)', 4)} AS q3
FROM v GROUP BY held_out, col
""")
def h_fold_quartiles(spark, sf_dir):
    """Quartiles of every fold's training rows after median imputation, all folds in the same jobs."""
    price = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice").cast("double"))
    rows = order_folds(spark, sf_dir).select("fold", price.alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    gaps = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count_if(F.col("price").isNull()).alias("n")).collect()}
    fills = quantiles_outside_folds(rows, ["price"], [0.5], "fold", 5)
    copies = {f: {"price": (fills[f]["price"][0], sum(n for g, n in gaps.items() if g != f))} for f in gaps}
    found = quantiles_outside_folds(rows, ["price", "customer"], [0.25, 0.5, 0.75], "fold", 5, copies)
    table_rows = [(f, c, *q) for f, cols in found.items() for c, q in cols.items()]   # one row a fold and column
    return spark.createDataFrame(table_rows, "held_out int, col string, q1 double, median double, q3 double").select(
        "held_out", "col", *[S.rnd(F.col(c), 4).alias(c) for c in ("q1", "median", "q3")])


# stand-in predictions (fixed rules) for the metric operators
_RULES = {
    "price_rule": ("CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' ELSE 'P' END",
                   lambda: F.when(F.col("o_totalprice") > 300000, "F")
                   .when(F.col("o_totalprice") > 150000, "O").otherwise("P")),
    "priority_rule": ("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'F' "
                      "WHEN o_orderpriority = '3-MEDIUM' THEN 'O' ELSE 'P' END",
                      lambda: F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "F")
                      .when(F.col("o_orderpriority") == "3-MEDIUM", "O").otherwise("P")),
    "constant_rule": ("'O'", lambda: F.lit("O")),
}


def _oof(spark, sf_dir, models):
    f = order_folds(spark, sf_dir)
    parts = [f.select(F.lit(m).alias("model"), F.col("o_orderkey").alias("key"), "fold",
                      F.col("o_orderstatus").alias("y"), _RULES[m][1]().alias("prediction")) for m in models]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _oof_sql(models):
    return " UNION ALL ".join(
        f"SELECT '{m}' AS model, o_orderkey AS key, fold, o_orderstatus AS y, {_RULES[m][0]} AS prediction "
        f"FROM ({FOLDS_SQL})" for m in models)


def _clf_metrics_sql(oof_sql):
    return f"""
conf AS (SELECT model, y AS t, prediction AS p, count(*) AS n FROM ({oof_sql}) WHERE y IS NOT NULL GROUP BY model, y, prediction),
roles AS (SELECT model, t AS c, n AS support, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS predicted FROM conf
          UNION ALL SELECT model, p, 0, 0, n FROM conf),
per AS (SELECT model, c, sum(support) AS support, sum(tp) AS tp, sum(predicted) AS predicted FROM roles GROUP BY model, c),
pr AS (SELECT model, support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
          CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM per),
m AS (SELECT model, sum(tp) / sum(support) AS accuracy, sum(prec * support) / sum(support) AS precision,
        sum(rec * support) / sum(support) AS recall,
        sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END * support) / sum(support) AS f1
      FROM pr GROUP BY model)"""


@register("h_fold_losses", f"""
SELECT fold, {R("1 - avg(CASE WHEN y = prediction THEN 1.0 ELSE 0.0 END)", 6)} AS loss
FROM ({_oof_sql(['price_rule'])}) GROUP BY fold
""")
def h_fold_losses(spark, sf_dir):
    """Per-fold loss (1 - accuracy) of an out-of-fold table (H7)."""
    losses = CV.fold_losses(_oof(spark, sf_dir, ["price_rule"]), "classification")
    return losses.select("fold", S.rnd(F.col("loss"), 6).alias("loss"))


@register("h_cv_summary", f"""
SELECT {R('avg(loss)', 6)} AS cv_loss_mean, {R('stddev_pop(loss)', 6)} AS cv_loss_std FROM (
  SELECT fold, 1 - avg(CASE WHEN y = prediction THEN 1.0 ELSE 0.0 END) AS loss
  FROM ({_oof_sql(['price_rule'])}) GROUP BY fold)
""")
def h_cv_summary(spark, sf_dir):
    """Mean and population std of fold losses (H8)."""
    s = CV.cv_summary(CV.fold_losses(_oof(spark, sf_dir, ["price_rule"]), "classification"))
    return s.select(S.rnd(F.col("cv_loss_mean"), 6).alias("cv_loss_mean"),
                    S.rnd(F.col("cv_loss_std"), 6).alias("cv_loss_std"))


@register("h_metrics_clf", f"""
WITH {_clf_metrics_sql(_oof_sql(['price_rule']))}
SELECT {R('accuracy')} AS accuracy, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1 FROM m
""")
def h_metrics_clf(spark, sf_dir):
    """Accuracy and weighted precision / recall / F1 on OOF predictions."""
    return CV.classification_metrics(_oof(spark, sf_dir, ["price_rule"]))


@register("h_metrics_reg", f"""
SELECT {R('sqrt(avg((y - p) * (y - p)))')} AS rmse, {R('avg(abs(y - p))')} AS mae,
  {R('CASE WHEN var_pop(y) * count(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) '
     'WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END')} AS r2
FROM (SELECT l_extendedprice AS y, l_quantity * 2100.0 AS p FROM lineitem)
""")
def h_metrics_reg(spark, sf_dir):
    """RMSE, MAE and R^2 of a stand-in prediction on all of ``lineitem``."""
    li = table(spark, sf_dir, "lineitem")
    oof = li.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2100.0).alias("prediction"))
    return CV.regression_metrics(oof)


_BOARD = ["price_rule", "priority_rule", "constant_rule"]


@register("h_leaderboard", f"""
WITH {_clf_metrics_sql(_oof_sql(_BOARD))},
fl AS (SELECT model, fold, 1 - avg(CASE WHEN y = prediction THEN 1.0 ELSE 0.0 END) AS loss
       FROM ({_oof_sql(_BOARD)}) GROUP BY model, fold),
s AS (SELECT model, avg(loss) AS mean_loss, stddev_pop(loss) AS std_loss FROM fl GROUP BY model)
SELECT s.model, {R('mean_loss')} AS cv_loss_mean, {R('std_loss')} AS cv_loss_std,
  {R('accuracy')} AS accuracy, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1,
  CAST(row_number() OVER (ORDER BY {R('mean_loss')}, s.model) AS INTEGER) AS rank
FROM s JOIN m ON s.model = m.model
""")
def h_leaderboard(spark, sf_dir):
    """Leaderboard of three scored prediction sets, all in one set of jobs."""
    board = CV.leaderboard(_oof(spark, sf_dir, _BOARD), "classification")
    return CV.rank_board(board)


@register("h_strata_two_bins", """
SELECT o_orderkey, CAST(CASE WHEN y IS NOT NULL THEN y > 3 END AS INTEGER) AS stratum
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN 6 ELSE 0 END AS y FROM orders)""")
def h_strata_two_bins(spark, sf_dir):
    """Strata of a target whose quantiles nearly all coincide: two equal-width bins (H3)."""
    k = F.col("o_orderkey")
    y = F.when(k % 11 == 0, F.lit(None).cast("int")).when(k % 50 == 1, 6).otherwise(0)
    o = table(spark, sf_dir, "orders").select("o_orderkey", y.alias("y"))
    return CV.regression_strata(o, "y", k=5, key_cols=["o_orderkey"], exact=True).select("o_orderkey", "stratum")


@register("h_strata_parity", """
SELECT o_orderkey, CAST((strpos('0123456789abcdef', substr(md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), 32, 1)) - 1) % 2 AS INTEGER) AS stratum
FROM orders""")
def h_strata_parity(spark, sf_dir):
    """Strata of a constant target: parity by the key's hash (H4)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(7.5).alias("y"))
    return CV.regression_strata(o, "y", k=5, key_cols=["o_orderkey"], exact=True).select("o_orderkey", "stratum")
