"""Queries for profiling (2.C)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strata.operators import profile as P
from strata.plans.catalog import register, table
from strata.plans.sqlgen import R, profile_sql

_ORDERS_COLS = [("o_orderkey", "bigint", True), ("o_custkey", "bigint", True),
                ("o_totalprice", "double", True), ("o_orderdate", "timestamp_ntz", False),
                ("o_orderpriority", "string", False)]


@register("c_profile_orders", profile_sql("orders", _ORDERS_COLS))
def c_profile_orders(spark, sf_dir):
    """Column profile of ``orders`` with target ``o_orderstatus``."""
    return P.column_profile(table(spark, sf_dir, "orders"), target="o_orderstatus")


# customer with nulls injected by fixed rules (the supplied tables have none)
CUSTOMER_NULLS_SQL = (
    "(SELECT c_custkey, c_name, c_nationkey, "
    "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, "
    "CASE WHEN c_nationkey < 10 THEN NULL ELSE c_mktsegment END AS c_segment, "
    "c_mktsegment FROM customer) cn")


def customer_nulls(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(~(F.col("c_acctbal") < 0), F.col("c_acctbal")).alias("c_acctbal"),
        F.when(~(F.col("c_nationkey") < 10), F.col("c_mktsegment")).alias("c_segment"),
        "c_mktsegment")


_CUST_COLS = [("c_custkey", "bigint", True), ("c_name", "string", False),
              ("c_nationkey", "int", True), ("c_acctbal", "double", True),
              ("c_segment", "string", False)]


@register("c_profile_customer_nulls", profile_sql(CUSTOMER_NULLS_SQL, _CUST_COLS))
def c_profile_customer_nulls(spark, sf_dir):
    """Column profile with NULLs in a numeric and a string column."""
    return P.column_profile(customer_nulls(spark, sf_dir), target="c_mktsegment")


@register("c_top_values_part", """
WITH long AS (
  SELECT 'p_name' AS col, p_name AS value FROM part
  UNION ALL SELECT 'p_brand', p_brand FROM part
  UNION ALL SELECT 'p_type', p_type FROM part),
counts AS (SELECT col, value, CAST(count(*) AS BIGINT) AS n FROM long WHERE value IS NOT NULL GROUP BY col, value),
ranked AS (SELECT col, value, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank FROM counts)
SELECT col, CAST(rank AS INTEGER) AS rank, value, n FROM ranked WHERE rank <= 5
""")
def c_top_values_part(spark, sf_dir):
    """Top-5 values of the non-numeric columns of ``part`` (C11)."""
    part = table(spark, sf_dir, "part")
    return P.top_values(part, ["p_name", "p_brand", "p_type"], n=5)


@register("c_target_stats_clf", f"""
WITH d AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality)
SELECT 'int' AS dtype, CAST((SELECT count(*) - count(quality) FROM labels) AS BIGINT) AS null_count,
  {R('(SELECT coalesce((count(*) - count(quality)) / count(*), 0) FROM labels)')} AS null_rate,
  CAST((SELECT count(DISTINCT quality) FROM labels) AS BIGINT) AS cardinality,
  CAST(count(*) AS BIGINT) AS n_classes,
  {R('max(n) / min(n)')} AS imbalance_ratio,
  coalesce({R('max(n) / min(n)')} > 3.0, FALSE) AS is_imbalanced
FROM d
""")
def c_target_stats_clf(spark, sf_dir):
    """Classification target profile of ``labels.quality``."""
    return P.target_stats(table(spark, sf_dir, "labels"), "quality", "classification")


@register("c_target_stats_reg", f"""
SELECT 'double' AS dtype, CAST(count(*) - count(o_totalprice) AS BIGINT) AS null_count,
  {R('coalesce((count(*) - count(o_totalprice)) / count(*), 0)')} AS null_rate,
  CAST(count(DISTINCT o_totalprice) AS BIGINT) AS cardinality,
  {R('avg(o_totalprice)')} AS mean, {R('stddev_samp(o_totalprice)')} AS std,
  {R('min(o_totalprice)')} AS min, {R('max(o_totalprice)')} AS max,
  CASE WHEN count(o_totalprice) < 3 THEN NULL ELSE {R('coalesce(skewness(o_totalprice), 0)')} END AS skew,
  FALSE AS is_imbalanced
FROM orders
""")
def c_target_stats_reg(spark, sf_dir):
    """Regression target profile of ``orders.o_totalprice``."""
    return P.target_stats(table(spark, sf_dir, "orders"), "o_totalprice", "regression")


DOC_LABELS_SQL = (
    "(SELECT d.doc_id, d.lang, d.source, d.text, "
    "CASE WHEN d.n_chars < 2000 THEN NULL ELSE d.n_chars END AS n_chars, l.quality "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id) dl")


def doc_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", "lang", "source", "text",
        F.when(~(F.col("n_chars") < 2000), F.col("n_chars")).alias("n_chars"), "quality")


def _warn_sql(frame_sql, cols_numeric, target):
    rows = []
    for c, numeric in cols_numeric:
        nr = R(f"coalesce((count(*) - count({c})) / count(*), 0)")
        cr = R(f"coalesce(count(DISTINCT {c}) / count(*), 0)")
        rows.append(f"SELECT '{c}' AS col, {nr} AS null_rate, {cr} AS card_rate, "
                    f"{str(numeric).upper()} AS is_numeric FROM {frame_sql}")
    prof = " UNION ALL ".join(rows)
    return f"""
WITH p AS ({prof}),
d AS (SELECT {target}, count(*) AS n FROM {frame_sql} WHERE {target} IS NOT NULL GROUP BY {target}),
r AS (SELECT {R('max(n) / min(n)')} AS ratio FROM d)
SELECT 'missing' AS kind, col, printf('''%s'' has %.1f%% missing values — may be dropped by cleaning', col, null_rate * 100) AS message
FROM p WHERE null_rate > 0.3
UNION ALL
SELECT 'id_like', col, printf('''%s'' has %.1f%% unique values — likely an ID column, will be dropped', col, card_rate * 100)
FROM p WHERE card_rate > 0.9 AND NOT is_numeric
UNION ALL
SELECT 'imbalanced', '{target}', printf('Target ''%s'' is imbalanced (ratio %.1fx) — consider class weighting', '{target}', ratio)
FROM r WHERE ratio > 3.0
"""


@register("c_warnings", _warn_sql(DOC_LABELS_SQL, [("doc_id", True), ("lang", False), ("source", False),
                                                   ("text", False), ("n_chars", True)], "quality"))
def c_warnings(spark, sf_dir):
    """Data-quality warnings for ``documents`` joined with ``labels``."""
    frame = doc_labels(spark, sf_dir)
    cp = P.column_profile(frame, target="quality")
    ts = P.target_stats(frame, "quality", "classification")
    return P.build_warnings(cp, "quality", ts)


# targets whose type is detected: (table, column, pandas dtype, numeric)
_VOTE_TARGETS = [("orders", "o_orderstatus", "object", False),
                 ("orders", "o_totalprice", "float64", True),
                 ("orders", "o_custkey", "int64", True),
                 ("labels", "quality", "int32", True),
                 ("customer", "c_nationkey", "int32", True),
                 ("lineitem", "l_quantity", "float64", True),
                 ("part", "p_size", "int32", True)]


def _votes_sql_one(tbl, col, pdt, numeric):
    in01 = (f"coalesce(bool_and(CASE WHEN {col} IS NOT NULL THEN CAST({col} AS DOUBLE) IN (0, 1) END), TRUE)"
            if numeric else f"count({col}) = 0")

    def vote(rule, task, conf, where="TRUE"):
        return f"SELECT '{rule}' AS rule, {task} AS task, {conf} AS confidence FROM f WHERE {where}"

    d = lambda v: f"CAST({v} AS DOUBLE)"
    parts = []
    if pdt == "object":
        parts.append(vote("data_type", "'classification'", d(0.95)))
    parts.append(vote("binary", "'classification'", f"CASE WHEN in01 THEN {d(0.99)} ELSE {d(0.90)} END",
                      "in01 OR nu = 2"))
    parts.append(vote("unique_count", "CASE WHEN nu <= 20 THEN 'classification' ELSE 'regression' END",
                      f"CASE WHEN nu <= 10 AND nn > 20 AND nu / nn < 0.3 THEN {d(0.95)} "
                      f"WHEN nu <= 20 THEN {d(0.80)} ELSE {d(0.75)} END"))
    parts.append(vote("unique_ratio", "CASE WHEN nu / nn < 0.05 THEN 'classification' ELSE 'regression' END",
                      f"CASE WHEN nu / nn < 0.05 THEN {d(0.85)} ELSE {d(0.80)} END",
                      "nn > 0 AND (nu / nn < 0.05 OR nu / nn > 0.5)"))
    if pdt in ("int64", "int32", "int16", "int8"):
        parts.append(vote("integer_pattern", "'classification'", d(0.70), "nu < 20"))
    if pdt in ("float64", "float32", "int64", "int32"):
        second = " OR nu / nn > 0.5" if pdt in ("int64", "int32") else ""
        parts.append(vote("continuous", "'regression'",
                          f"CASE WHEN nu / nn > 0.8 THEN {d(0.95)} ELSE {d(0.90)} END",
                          f"nn > 0 AND (nu / nn > 0.8{second})"))
    body = " UNION ALL ".join(parts)
    return (f"SELECT '{tbl}.{col}' AS target, * FROM (WITH f AS (SELECT count(*) AS n, count({col}) AS nn, "
            f"count(DISTINCT {col}) AS nu, {in01} AS in01 FROM {tbl}) {body})")


_VOTES_SQL = " UNION ALL ".join(_votes_sql_one(*t) for t in _VOTE_TARGETS)


def _all_votes(spark, sf_dir):
    frames = [P.task_votes(table(spark, sf_dir, t), c).select(F.lit(f"{t}.{c}").alias("target"), "*")
              for t, c, _, _ in _VOTE_TARGETS]
    return reduce(lambda a, b: a.unionByName(b), frames)


@register("c_task_votes", _VOTES_SQL)
def c_task_votes(spark, sf_dir):
    """Votes of the six detection rules for seven candidate targets."""
    return _all_votes(spark, sf_dir)


@register("c_task_detect", f"""
WITH v AS ({_VOTES_SQL})
SELECT target,
  CASE WHEN coalesce(sum(CASE WHEN task = 'classification' THEN confidence END), 0)
         >= coalesce(sum(CASE WHEN task = 'regression' THEN confidence END), 0)
       THEN 'classification' ELSE 'regression' END AS task_type,
  {R('''coalesce(CASE WHEN coalesce(sum(CASE WHEN task = 'classification' THEN confidence END), 0)
         >= coalesce(sum(CASE WHEN task = 'regression' THEN confidence END), 0)
       THEN avg(CASE WHEN task = 'classification' THEN confidence END)
       ELSE avg(CASE WHEN task = 'regression' THEN confidence END) END, 0.5)''')} AS confidence
FROM v GROUP BY target
""")
def c_task_detect(spark, sf_dir):
    """Task decision (type, confidence) for seven candidate targets."""
    frames = [P.detect_task(table(spark, sf_dir, t), c).select(F.lit(f"{t}.{c}").alias("target"), "*")
              for t, c, _, _ in _VOTE_TARGETS]
    return reduce(lambda a, b: a.unionByName(b), frames)


@register("c_memory", """
SELECT CAST(count(*) * 32 + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority)) AS BIGINT) AS bytes,
  CAST(count(*) AS BIGINT) AS n,
  (CASE WHEN abs((count(*) * 32 + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority))) / 1048576.0) * 1e3 < 4.5e15
        THEN floor(CAST((count(*) * 32 + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority))) / 1048576.0 AS DOUBLE) * 1e3 + 0.5) / 1e3 END) AS memory_mb
FROM orders
""")
def c_memory(spark, sf_dir):
    """Logical table size: fixed widths plus string bytes (C12, re-aimed)."""
    return P.memory_bytes(table(spark, sf_dir, "orders"))


_DETAIL_TARGETS = [("orders", "o_orderstatus", "o_orderkey", "object"),
                   ("orders", "o_totalprice", "o_orderkey", "float64"),
                   ("labels", "quality", "doc_id", "int32")]


def _details_sql():
    parts = []
    for tbl, col, key, pdt in _DETAIL_TARGETS:
        votes = _votes_sql_one(tbl, col, pdt, pdt != "object")
        conf = R('''coalesce(CASE WHEN coalesce(sum(CASE WHEN task = 'classification' THEN confidence END), 0)
             >= coalesce(sum(CASE WHEN task = 'regression' THEN confidence END), 0)
           THEN avg(CASE WHEN task = 'classification' THEN confidence END)
           ELSE avg(CASE WHEN task = 'regression' THEN confidence END) END, 0.5)''')
        parts.append(f"""SELECT '{tbl}.{col}' AS target, d.task_type, d.dconf AS confidence, f.n_samples, f.n_unique,
  coalesce({R('f.n_unique / f.nn')}, 0.0) AS unique_ratio, '{pdt}' AS dtype, f.n_samples - f.nn AS null_count,
  coalesce({R('(f.n_samples - f.nn) / f.n_samples')}, 0.0) AS null_rate, s.sample_values
FROM (SELECT CAST(count(*) AS BIGINT) AS n_samples, count({col}) AS nn, CAST(count(DISTINCT {col}) AS BIGINT) AS n_unique FROM {tbl}) f,
  (SELECT CASE WHEN coalesce(sum(CASE WHEN task = 'classification' THEN confidence END), 0)
         >= coalesce(sum(CASE WHEN task = 'regression' THEN confidence END), 0)
       THEN 'classification' ELSE 'regression' END AS task_type, {conf} AS dconf FROM ({votes})) d,
  (SELECT list(CAST({col} AS VARCHAR) ORDER BY {key}) AS sample_values FROM
     (SELECT {col}, {key} FROM {tbl} WHERE {col} IS NOT NULL ORDER BY {key} LIMIT 10)) s""")
    return " UNION ALL ".join(f"SELECT target, task_type, confidence, n_samples, n_unique, unique_ratio, dtype, "
                              f"CAST(null_count AS BIGINT) AS null_count, null_rate, sample_values FROM ({p})"
                              for p in parts)


@register("c_detection_details", _details_sql())
def c_detection_details(spark, sf_dir):
    """Detection facts with the first ten values by key."""
    out = [P.detection_details_table(table(spark, sf_dir, t), c, [k]).select(F.lit(f"{t}.{c}").alias("target"), "*")
           for t, c, k, _ in _DETAIL_TARGETS]
    return reduce(lambda a, b: a.unionByName(b), out)


@register("c_simple_detect", """
SELECT 'o_orderstatus' AS target, 'classification' AS task_type
UNION ALL SELECT 'o_totalprice', CASE WHEN (SELECT count(DISTINCT o_totalprice) FROM orders) <= 15 THEN 'classification' ELSE 'regression' END
UNION ALL SELECT 'o_orderpriority', 'classification'
UNION ALL SELECT 'o_custkey', CASE WHEN (SELECT count(DISTINCT o_custkey) FROM orders) <= 15 THEN 'classification' ELSE 'regression' END
""")
def c_simple_detect(spark, sf_dir):
    """Fallback task detector over four candidate targets in one aggregate."""
    return P.simple_task_types(table(spark, sf_dir, "orders"),
                               ["o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey"])
