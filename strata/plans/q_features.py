"""Queries for the feature catalogue (2.J)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.functions import features as FE
from strata.functions import stats as S
from strata.plans.catalog import register, table
from strata.plans.q_profile import CUSTOMER_NULLS_SQL, customer_nulls
from strata.plans.sqlgen import R


def _out(df, keys, cols, digits=6):
    return df.select(*keys, *[S.rnd(F.col(c), digits).alias(c) for c in cols])


@register("j_arith", f"""
SELECT l_orderkey, l_linenumber, {R('l_quantity + l_tax', 6)} AS qty_plus_tax,
  {R('l_extendedprice - l_discount', 6)} AS price_minus_disc, {R('l_quantity * l_discount', 6)} AS qty_x_disc,
  {R('pow(l_quantity, 2.0)', 6)} AS qty_sq, {R('sin(l_quantity)', 6)} AS qty_sin,
  {R('0.5 * l_quantity + 0.3 * l_tax * 100 - 0.2 * l_discount * 100', 6)} AS score,
  {R('sqrt(l_quantity * l_quantity + l_tax * l_tax)', 6)} AS qty_tax_dist,
  CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS n_rows
FROM lineitem
""")
def j_arith(spark, sf_dir):
    """Sums, differences, products, powers, trig, weighted score, hypot, row count."""
    li = table(spark, sf_dir, "lineitem")
    feats = [FE.Expr("qty_plus_tax", "l_quantity + l_tax"),
             FE.Expr("price_minus_disc", "l_extendedprice - l_discount"),
             FE.Expr("qty_x_disc", "l_quantity * l_discount"),
             FE.Power("qty_sq", "l_quantity", 2.0), FE.Expr("qty_sin", "sin(l_quantity)"),
             FE.Expr("score", "0.5 * l_quantity + 0.3 * l_tax * 100 - 0.2 * l_discount * 100"),
             FE.Hypot("qty_tax_dist", "l_quantity", "l_tax"), FE.RowCount("n_rows")]
    out = FE.apply_features(feats, li)
    return _out(out, ["l_orderkey", "l_linenumber", "n_rows"],
                ["qty_plus_tax", "price_minus_disc", "qty_x_disc", "qty_sq", "qty_sin", "score", "qty_tax_dist"])


@register("j_ratio", f"""
SELECT l_orderkey, l_linenumber, {R('l_extendedprice / (l_quantity + 1e-9)', 6)} AS price_per_qty,
  {R('l_extendedprice / (l_quantity * l_tax + 1e-9)', 6)} AS density
FROM lineitem
""")
def j_ratio(spark, sf_dir):
    """Safe ratios and a compound density with epsilon denominators."""
    li = table(spark, sf_dir, "lineitem")
    out = FE.apply_features([FE.Ratio("price_per_qty", "l_extendedprice", "l_quantity"),
                             FE.Ratio("density", "l_extendedprice", "l_quantity * l_tax")], li)
    return _out(out, ["l_orderkey", "l_linenumber"], ["price_per_qty", "density"])


@register("j_logs", f"""
SELECT l_orderkey, l_linenumber, {R('ln(1 + l_discount)', 6)} AS disc_log1p,
  {R('log2(greatest(l_quantity, 1.0))', 6)} AS qty_log2, {R('sqrt(abs(l_tax))', 6)} AS tax_sqrt
FROM lineitem
""")
def j_logs(spark, sf_dir):
    """log1p, floored log2 and sqrt of abs."""
    li = table(spark, sf_dir, "lineitem")
    out = FE.apply_features([FE.Log1p("disc_log1p", "l_discount"), FE.Log2Floor("qty_log2", "l_quantity"),
                             FE.SqrtAbs("tax_sqrt", "l_tax")], li)
    return _out(out, ["l_orderkey", "l_linenumber"], ["disc_log1p", "qty_log2", "tax_sqrt"])


@register("j_zscore", f"""
SELECT l_orderkey, l_linenumber,
  {R('(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / ((SELECT stddev_samp(l_extendedprice) FROM lineitem) + 1e-9)', 6)} AS price_z
FROM lineitem
""")
def j_zscore(spark, sf_dir):
    """z-score with sample std and epsilon, statistics fitted on the rows."""
    li = table(spark, sf_dir, "lineitem")
    out = FE.apply_features([FE.ZScore("price_z", "l_extendedprice")], li)
    return _out(out, ["l_orderkey", "l_linenumber"], ["price_z"])


@register("j_iqr_clip", f"""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT o_orderkey, {R('least(greatest(o_totalprice, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1))', 4)} AS price_iqr,
  {R('least(greatest(o_totalprice, 50000.0), 400000.0)', 4)} AS price_clip
FROM orders, q
""")
def j_iqr_clip(spark, sf_dir):
    """Clip to IQR fences and to constants."""
    o = table(spark, sf_dir, "orders")
    out = FE.apply_features([FE.IQRClip("price_iqr", "o_totalprice"),
                             FE.Clip("price_clip", "o_totalprice", 50000, 400000)], o)
    return _out(out, ["o_orderkey"], ["price_iqr", "price_clip"], 4)


@register("j_pct_rank", f"""
SELECT l_orderkey, l_linenumber,
  {R('(rank() OVER (ORDER BY l_quantity) - 1 + (count(*) OVER (PARTITION BY l_quantity) + 1) / CAST(2 AS DOUBLE)) / count(l_quantity) OVER ()', 8)} AS qty_pct,
  {R('(rank() OVER (ORDER BY l_extendedprice) - 1 + (count(*) OVER (PARTITION BY l_extendedprice) + 1) / CAST(2 AS DOUBLE)) / count(l_extendedprice) OVER ()', 8)} AS price_pct
FROM lineitem
""")
def j_pct_rank(spark, sf_dir):
    """Percentile rank with average ties, without a single-task window."""
    li = table(spark, sf_dir, "lineitem")
    out = FE.apply_features([FE.PctRank("qty_pct", "l_quantity"), FE.PctRank("price_pct", "l_extendedprice")], li)
    return _out(out, ["l_orderkey", "l_linenumber"], ["qty_pct", "price_pct"], 8)


def _bins_sql(bins):
    flags = " + ".join(f"CASE WHEN o_totalprice > {i}.0 * ((mx - mn) / {bins}.0) + mn THEN 1 ELSE 0 END"
                       for i in range(1, bins))
    return f"""
WITH r AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders)
SELECT o_orderkey, CAST({flags} AS INTEGER) AS price_bin,
  CASE WHEN o_totalprice <= 100000 THEN 'small' WHEN o_totalprice <= 300000 THEN 'medium' ELSE 'large' END AS price_band
FROM orders, r
"""


@register("j_bins", _bins_sql(5))
def j_bins(spark, sf_dir):
    """Equal-width bin codes and named bins by cut points."""
    o = table(spark, sf_dir, "orders")
    out = FE.apply_features([
        FE.EqualWidthBins("price_bin", "o_totalprice", 5),
        FE.NamedBins("price_band", "o_totalprice", [float("-inf"), 100000, 300000, float("inf")],
                     ["small", "medium", "large"])], o)
    return out.select("o_orderkey", "price_bin", "price_band")


@register("j_flags", """
SELECT o_orderkey, CAST(o_totalprice > 200000 AS INTEGER) AS big_order,
  CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS urgent
FROM orders
""")
def j_flags(spark, sf_dir):
    """Indicator flags."""
    o = table(spark, sf_dir, "orders")
    out = FE.apply_features([FE.Flag("big_order", "o_totalprice > 200000"),
                             FE.Flag("urgent", "o_orderpriority = '1-URGENT'")], o)
    return out.select("o_orderkey", "big_order", "urgent")


@register("j_regex", r"""
SELECT c_custkey, TRY_CAST(NULLIF(regexp_extract(c_name, '#(\d+)', 1), '') AS DOUBLE) AS cust_no,
  NULLIF(regexp_extract(c_name, '^([A-Za-z]+)#', 1), '') AS name_word
FROM customer
""")
def j_regex(spark, sf_dir):
    """Regex extraction to a number and to text."""
    c = table(spark, sf_dir, "customer")
    out = FE.apply_features([FE.RegexNumber("cust_no", "c_name", r"#(\d+)"),
                             FE.RegexText("name_word", "c_name", r"^([A-Za-z]+)#")], c)
    return out.select("c_custkey", "cust_no", "name_word")


@register("j_regex_props", r"""
SELECT event_id, TRY_CAST(NULLIF(regexp_extract(props, '"k": (\d+)', 1), '') AS DOUBLE) AS k
FROM events
""")
def j_regex_props(spark, sf_dir):
    """Number pulled out of a JSON-like text column."""
    e = table(spark, sf_dir, "events")
    out = FE.apply_features([FE.RegexNumber("k", "props", r'"k": (\d+)')], e)
    return out.select("event_id", "k")


@register("j_group_agg", f"""
WITH p AS (SELECT o_orderpriority AS g, avg(o_totalprice) AS v FROM orders GROUP BY o_orderpriority),
c AS (SELECT o_custkey AS g, count(o_orderkey) AS v FROM orders GROUP BY o_custkey)
SELECT o_orderkey, {R('p.v', 4)} AS prio_mean_price, CAST(c.v AS BIGINT) AS cust_orders
FROM orders LEFT JOIN p ON orders.o_orderpriority = p.g LEFT JOIN c ON orders.o_custkey = c.g
""")
def j_group_agg(spark, sf_dir):
    """Group aggregates joined back to the rows."""
    o = table(spark, sf_dir, "orders")
    out = FE.apply_features([FE.GroupAgg("prio_mean_price", "o_orderpriority", "o_totalprice", "mean"),
                             FE.GroupAgg("cust_orders", "o_custkey", "o_orderkey", "count")], o)
    return out.select("o_orderkey", S.rnd(F.col("prio_mean_price"), 4).alias("prio_mean_price"),
                      F.col("cust_orders").cast("bigint").alias("cust_orders"))


@register("j_fill", f"""
SELECT c_custkey, {R('coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM ' + CUSTOMER_NULLS_SQL + '))', 4)} AS bal_median,
  {R('coalesce(c_acctbal, 0.0)', 4)} AS bal_zero, coalesce(c_segment, 'missing') AS seg_filled
FROM {CUSTOMER_NULLS_SQL}
""")
def j_fill(spark, sf_dir):
    """Missing values filled with the median and with constants."""
    df = customer_nulls(spark, sf_dir)
    out = FE.apply_features([FE.Fill("bal_median", "c_acctbal", "median"),
                             FE.Fill("bal_zero", "c_acctbal", "constant", 0.0),
                             FE.Fill("seg_filled", "c_segment", "constant", "missing")], df)
    return out.select("c_custkey", S.rnd(F.col("bal_median"), 4).alias("bal_median"),
                      S.rnd(F.col("bal_zero"), 4).alias("bal_zero"), "seg_filled")


def _tanh10(s):
    return np.tanh(s * 10.0)


@register("j_pandas_udf", f"""
SELECT l_orderkey, l_linenumber, {R('tanh(l_discount * 10.0)', 6)} AS disc_tanh FROM lineitem
""")
def j_pandas_udf(spark, sf_dir):
    """Element-wise user function over Arrow batches."""
    li = table(spark, sf_dir, "lineitem")
    out = FE.apply_features([FE.PandasMap("disc_tanh", ["l_discount"], _tanh10)], li)
    return _out(out, ["l_orderkey", "l_linenumber"], ["disc_tanh"])


def _line_share(df):
    w = Window.partitionBy("l_orderkey")
    return df.withColumn("line_share", F.col("l_extendedprice") / F.sum("l_extendedprice").over(w))


@register("j_frame_fn", f"""
SELECT l_orderkey, l_linenumber,
  {R('l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey)', 6)} AS line_share,
  {R('l_quantity * 2', 6)} AS l_quantity
FROM lineitem
""")
def j_frame_fn(spark, sf_dir):
    """A whole-frame user function plus an overwritten column."""
    li = table(spark, sf_dir, "lineitem")
    out = FE.apply_features([FE.FrameFunction("line_share", _line_share),
                             FE.Expr("l_quantity", "l_quantity * 2")], li)
    return _out(out, ["l_orderkey", "l_linenumber"], ["line_share", "l_quantity"])


def _context_sql():
    from strata.plans.q_profile import _CUST_COLS
    prof = []
    for c, dtype, num in _CUST_COLS:
        x = f"CAST({c} AS DOUBLE)"
        stats = (f"{R(f'avg({x})')} AS mean, {R(f'stddev_samp({x})')} AS std, "
                 f"CASE WHEN count({x}) < 3 THEN NULL ELSE {R(f'coalesce(skewness({x}), 0)')} END AS skew"
                 if num else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS skew")
        prof.append(f"SELECT '{c}' AS col, '{dtype}' AS dtype, {stats}, "
                    f"{R(f'coalesce((count(*) - count({c})) / count(*), 0)')} AS null_rate FROM {CUSTOMER_NULLS_SQL}")
    cats = [c for c, _, num in _CUST_COLS if not num]
    top = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {CUSTOMER_NULLS_SQL}"
                             for c in cats)
    return f"""
WITH p AS ({' UNION ALL '.join(prof)}),
cnt AS (SELECT col, value, count(*) AS n FROM ({top}) WHERE value IS NOT NULL GROUP BY col, value),
rk AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS r FROM cnt),
t AS (SELECT col, list(value || '(' || CAST(n AS VARCHAR) || ')' ORDER BY r) AS top_values FROM rk WHERE r <= 3 GROUP BY col)
SELECT p.col, p.dtype, p.mean, p.std, p.skew, p.null_rate, t.top_values FROM p LEFT JOIN t ON p.col = t.col
"""


@register("k_candidate_context", _context_sql())
def k_candidate_context(spark, sf_dir):
    """Per-column context for candidate generation: moments, null rate, top-3 values (K9)."""
    from strata.operators import profile as P
    from strata.operators import search as K
    df = customer_nulls(spark, sf_dir)
    cp = P.column_profile(df, target="c_mktsegment")
    top = P.top_values(df, ["c_name", "c_segment"], 3)
    return K.candidate_context(cp, top)


@register("b_remap_drop", """
SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS label,
  'label' AS added FROM orders""")
def b_remap_drop(spark, sf_dir):
    """Label values by a map, leakage columns dropped whether present or not, the added columns named."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    out = FE.apply_features([FE.Remap("label", "o_orderstatus", {"F": "finished", "O": "open"})], o)
    added = ",".join(FE.added_columns(o, out))
    return out.drop("o_orderstatus", "o_orderpriority", "no_such_column").withColumn("added", F.lit(added))


_FAMILY = """(SELECT l_partkey, CAST(max(l_quantity) AS DOUBLE) AS qty_worst, avg(CAST(l_quantity AS DOUBLE)) AS qty_mean, CAST(max(l_discount) AS DOUBLE) AS disc_worst,
  avg(CAST(l_discount AS DOUBLE)) AS disc_mean, CAST(max(l_tax) AS DOUBLE) AS tax_worst FROM lineitem GROUP BY l_partkey)"""


@register("j_family_ratios", f"""
SELECT l_partkey, {R('qty_worst / (qty_mean + 1e-9)')} AS qty_ratio, CASE WHEN disc_mean + 1e-9 <> 0 THEN {R('disc_worst / (disc_mean + 1e-9)')} END AS disc_ratio,
  {R('4.0 / 3 * pi() * pow(qty_mean / 50, 3)')} AS volume, {R('qty_worst * qty_worst / (qty_mean + 1) - 1')} AS compactness FROM {_FAMILY}""")
def j_family_ratios(spark, sf_dir):
    """Worst / mean of every measurement that has both, and closed formulas."""
    li = table(spark, sf_dir, "lineitem")
    d = li.groupBy("l_partkey").agg(F.max("l_quantity").cast("double").alias("qty_worst"), F.avg(F.col("l_quantity").cast("double")).alias("qty_mean"),
                                    F.max("l_discount").cast("double").alias("disc_worst"), F.avg(F.col("l_discount").cast("double")).alias("disc_mean"),
                                    F.max("l_tax").cast("double").alias("tax_worst"))
    out = FE.apply_features([*FE.family_ratios(d.columns, "_worst", "_mean"), FE.Expr("volume", "4.0D / 3 * pi() * pow(qty_mean / 50, 3)"),
                             FE.Expr("compactness", "qty_worst * qty_worst / (qty_mean + 1) - 1")], d)
    return out.select("l_partkey", *[S.rnd(F.col(c), 4).alias(c) for c in ("qty_ratio", "disc_ratio", "volume", "compactness")])
