"""Queries for the EDA tables (2.D)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strata.operators import eda as E
from strata.operators import profile as P
from strata.plans.catalog import register, table
from strata.plans.q_profile import CUSTOMER_NULLS_SQL, customer_nulls
from strata.plans.sqlgen import R


def _hist_left_sql(tbl, col, bins):
    return f"""
WITH r AS (SELECT min(CAST({col} AS DOUBLE)) AS mn, max(CAST({col} AS DOUBLE)) AS mx FROM {tbl}),
b AS (SELECT least(floor((CAST({col} AS DOUBLE) - mn) / (mx - mn) * {bins}.0), {bins - 1}) AS bin
      FROM {tbl}, r WHERE {col} IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
g AS (SELECT range AS bin FROM range({bins}))
SELECT CAST(g.bin AS INTEGER) AS bin, {R(f'g.bin * ((mx - mn) / {bins}.0) + mn')} AS lo,
  {R(f'CASE WHEN g.bin = {bins - 1} THEN mx ELSE (g.bin + 1) * ((mx - mn) / {bins}.0) + mn END')} AS hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g CROSS JOIN r LEFT JOIN c ON c.bin = g.bin
"""


@register("d_hist_left", _hist_left_sql("lineitem", "l_extendedprice", 30))
def d_hist_left(spark, sf_dir):
    """30-bin left-closed histogram of ``l_extendedprice``."""
    return E.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", bins=30, closed="left")


def _hist_right_sql(tbl, col, bins):
    flags = " + ".join(f"CASE WHEN x > {i}.0 * ((mx - mn) / {bins}.0) + mn THEN 1 ELSE 0 END"
                       for i in range(1, bins))
    return f"""
WITH r AS (SELECT min(CAST({col} AS DOUBLE)) AS mn, max(CAST({col} AS DOUBLE)) AS mx FROM {tbl}),
v AS (SELECT CAST({col} AS DOUBLE) AS x FROM {tbl} WHERE {col} IS NOT NULL),
b AS (SELECT {flags} AS bin FROM v, r),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin),
g AS (SELECT range AS bin FROM range({bins}))
SELECT CAST(g.bin AS INTEGER) AS bin, {R(f'g.bin * ((mx - mn) / {bins}.0) + mn')} AS lo,
  {R(f'CASE WHEN g.bin = {bins - 1} THEN mx ELSE (g.bin + 1) * ((mx - mn) / {bins}.0) + mn END')} AS hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n,
  printf('%.2g', CASE WHEN g.bin = 0 THEN mn - (mx - mn) * 0.001 ELSE g.bin * ((mx - mn) / {bins}.0) + mn END)
    || '–' || printf('%.2g', CASE WHEN g.bin = {bins - 1} THEN mx ELSE (g.bin + 1) * ((mx - mn) / {bins}.0) + mn END) AS label
FROM g CROSS JOIN r LEFT JOIN c ON c.bin = g.bin
"""


@register("d_hist_right", _hist_right_sql("orders", "o_totalprice", 20))
def d_hist_right(spark, sf_dir):
    """20-bin right-closed (pandas.cut) histogram of ``o_totalprice`` with interval labels (D3)."""
    return E.histogram(table(spark, sf_dir, "orders"), "o_totalprice", bins=20, closed="right", labels=True)


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _multi_hist_sql():
    parts = []
    for c in _LI_NUM:
        parts.append(f"""SELECT '{c}' AS col, bin, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT least(floor((CAST({c} AS DOUBLE) - mn) / (mx - mn) * 30.0), 29) AS bin
  FROM lineitem, (SELECT min(CAST({c} AS DOUBLE)) AS mn, max(CAST({c} AS DOUBLE)) AS mx FROM lineitem)
  WHERE {c} IS NOT NULL) GROUP BY bin""")
    return "SELECT col, CAST(bin AS INTEGER) AS bin, n FROM (" + " UNION ALL ".join(parts) + ")"


@register("d_hist_multi", _multi_hist_sql())
def d_hist_multi(spark, sf_dir):
    """30-bin histograms of the numeric features of ``lineitem`` in one job."""
    return E.feature_histograms(table(spark, sf_dir, "lineitem"), target="l_extendedprice")


@register("d_target_bars", """
SELECT CAST(o_orderpriority AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
""")
def d_target_bars(spark, sf_dir):
    """Class counts of a categorical target."""
    return E.target_bars(table(spark, sf_dir, "orders"), "o_orderpriority", "classification")


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _corr_expr(a, b):
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    x = f"CASE WHEN {both} THEN CAST({a} AS DOUBLE) END"
    y = f"CASE WHEN {both} THEN CAST({b} AS DOUBLE) END"
    return (f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 0 THEN "
            f"covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END")


def _corr_matrix_sql(tbl, cols, digits):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            r = R(_corr_expr(a, b), digits)
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r} AS r FROM {tbl}")
            if a != b:
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {r} AS r FROM {tbl}")
    return " UNION ALL ".join(parts)


@register("d_corr_matrix", _corr_matrix_sql("lineitem", _CORR_COLS, 2))
def d_corr_matrix(spark, sf_dir):
    """Pairwise-complete Pearson matrix, rounded 2."""
    return E.correlation_matrix(table(spark, sf_dir, "lineitem"), _CORR_COLS, digits=2)


def _corr_target_sql():
    feats = [c for c in _LI_NUM]
    parts = [f"SELECT '{c}' AS feature, {R(_corr_expr(c, 'l_extendedprice'))} AS r FROM lineitem" for c in feats]
    return (f"SELECT feature, r, CAST(row_number() OVER (ORDER BY abs(r) DESC, feature) AS INTEGER) AS rank "
            f"FROM ({' UNION ALL '.join(parts)}) WHERE r IS NOT NULL")


@register("d_corr_target", _corr_target_sql())
def d_corr_target(spark, sf_dir):
    """Feature -> target correlations ranked by |r|."""
    li = table(spark, sf_dir, "lineitem").drop("l_returnflag", "l_linestatus", "l_shipdate")
    return E.target_correlation(li, "l_extendedprice")


@register("d_duplicates", f"""
SELECT 'lineitem_flags' AS frame, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (
  SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount)
UNION ALL
SELECT 'orders', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders
  GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)
UNION ALL
SELECT 'customer_nulls', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (
  SELECT count(*) AS n FROM {CUSTOMER_NULLS_SQL} GROUP BY c_nationkey, c_segment)
""")
def d_duplicates(spark, sf_dir):
    """Duplicate rows beyond the first, NULLs grouping together."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    frames = {"lineitem_flags": li, "orders": table(spark, sf_dir, "orders"),
              "customer_nulls": customer_nulls(spark, sf_dir).select("c_nationkey", "c_segment")}
    out = [E.duplicate_rows(df).select(F.lit(k).alias("frame"), "duplicate_rows") for k, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), out)


_CN_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_segment", "c_mktsegment"]


@register("d_shape", f"""
SELECT CAST(sum(n) AS BIGINT) AS rows, 6 AS columns, 3 AS numeric, 3 AS categorical,
  CAST(sum(n * nulls) AS BIGINT) AS missing_cells, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n, {' + '.join(f'(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)' for c in _CN_COLS)} AS nulls
      FROM {CUSTOMER_NULLS_SQL} GROUP BY {', '.join(_CN_COLS)})
""")
def d_shape(spark, sf_dir):
    """Shape row: rows, columns, numeric, categorical, missing cells, duplicates."""
    return E.shape_summary(customer_nulls(spark, sf_dir))


@register("d_missing", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS col, {R(f'(count(*) - count({c})) * 100.0 / count(*)', 1)} AS missing_pct "
    f"FROM {CUSTOMER_NULLS_SQL}) WHERE missing_pct > 0" for c in _CN_COLS[:-1]))
def d_missing(spark, sf_dir):
    """Missing % per column, only columns with gaps."""
    return E.missing_pct(customer_nulls(spark, sf_dir), target="c_mktsegment")


@register("d_balance", f"""
WITH g AS (SELECT quality AS value, count(*) AS n FROM labels GROUP BY quality)
SELECT CAST(count(value) AS BIGINT) AS n_classes,
  CAST(coalesce(sum(CASE WHEN value IS NULL THEN n END), 0) AS BIGINT) AS nulls,
  {R('max(CASE WHEN value IS NOT NULL THEN n END) / sum(CASE WHEN value IS NOT NULL THEN n END)')} AS majority_share,
  count(value) = 2 AS is_binary,
  count(value) = 2 AND {R('max(CASE WHEN value IS NOT NULL THEN n END) / sum(CASE WHEN value IS NOT NULL THEN n END)')} > 0.75 AS imbalanced
FROM g
""")
def d_balance(spark, sf_dir):
    """Binary target balance and its warning flag."""
    return E.target_balance(table(spark, sf_dir, "labels"), "quality")


@register("d_target_range", f"""
SELECT {R('min(o_totalprice)', 2)} AS min, {R('avg(o_totalprice)', 2)} AS mean, {R('max(o_totalprice)', 2)} AS max
FROM orders
""")
def d_target_range(spark, sf_dir):
    """Numeric target min / mean / max."""
    return E.target_range(table(spark, sf_dir, "orders"), "o_totalprice")


def _summary_sql():
    types = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
             "c_segment": "string"}
    parts = []
    for c, t in types.items():
        num = t != "string"
        x = f"CAST({c} AS DOUBLE)"
        mn = R(f"min({x})") if num else "CAST(NULL AS DOUBLE)"
        mean = R(f"avg({x})", 3) if num else "CAST(NULL AS DOUBLE)"
        mx = R(f"max({x})") if num else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS col, '{t}' AS dtype, CAST(count({c}) AS BIGINT) AS non_null, "
            f"{R(f'(count(*) - count({c})) / count(*) * 100', 1)} AS null_pct, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS \"unique\", {mn} AS min, {mean} AS mean, {mx} AS max "
            f"FROM {CUSTOMER_NULLS_SQL}")
    return " UNION ALL ".join(parts)


@register("d_column_summary", _summary_sql())
def d_column_summary(spark, sf_dir):
    """Column summary table."""
    return E.column_summary(customer_nulls(spark, sf_dir), target="c_mktsegment")


@register("d_null_totals", f"""
SELECT CAST(sum(nc) AS BIGINT) AS total_nulls, {R('sum(nc) * 100.0 / (max(n) * count(*))', 1)} AS null_pct
FROM ({' UNION ALL '.join(f'SELECT count(*) - count({c}) AS nc, count(*) AS n FROM {CUSTOMER_NULLS_SQL}' for c in _CN_COLS[:-1])})
""")
def d_null_totals(spark, sf_dir):
    """Total nulls and % of all feature cells."""
    cp = P.column_profile(customer_nulls(spark, sf_dir), target="c_mktsegment", include_n=True)
    return E.null_totals(cp)


def _skew_sql():
    frames = [("events", ["event_id", "user_id", "value"]), ("documents", ["doc_id", "n_chars"])]
    parts = []
    for f, cols in frames:
        for c in cols:
            x = f"CAST({c} AS DOUBLE)"
            parts.append(f"SELECT '{f}' AS frame, '{c}' AS col, CASE WHEN count({x}) < 3 THEN NULL "
                         f"ELSE {R(f'coalesce(skewness({x}), 0)')} END AS skew FROM {f}")
    return (f"SELECT * FROM (SELECT frame, col, skew, CAST(row_number() OVER (PARTITION BY frame "
            f"ORDER BY abs(skew) DESC, col) AS INTEGER) AS rank FROM ({' UNION ALL '.join(parts)}) "
            f"WHERE abs(skew) > 1.0) WHERE rank <= 5")


@register("d_skewed", _skew_sql())
def d_skewed(spark, sf_dir):
    """Most skewed numeric features, |skew| > 1, top 5 per frame."""
    out = []
    for f, target in (("events", "event_type"), ("documents", "lang")):
        df = table(spark, sf_dir, f)
        cp = P.column_profile(df, target=target)
        out.append(E.most_skewed(cp).select(F.lit(f).alias("frame"), "*"))
    return reduce(lambda a, b: a.unionByName(b), out)


@register("d_corr_wide", f"""
WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings),
v AS (SELECT vec_id, 'e' || i AS col, CASE WHEN (vec_id + i) % 9 > 0 THEN CAST(x AS DOUBLE) END AS x FROM e)
SELECT a.col AS col_a, b.col AS col_b, {R('corr(a.x, b.x)')} AS r FROM v a JOIN v b USING (vec_id)
WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY a.col, b.col""")
def d_corr_wide(spark, sf_dir):
    """Pairwise-complete Pearson matrix of 64 columns with NULLs, by matrix products."""
    e = table(spark, sf_dir, "embeddings")
    df = e.select(*[F.when((F.col("vec_id") + i) % 9 > 0, F.col("embedding")[i].cast("double")).alias(f"e{i}") for i in range(64)])
    return E.correlation_matrix(df, digits=4)
