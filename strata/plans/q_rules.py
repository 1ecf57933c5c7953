"""Queries on what must hold whatever the data: rejected features, NULL strata, many categories, CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strata.functions import features as FE
from strata.operators import cv as CV
from strata.operators import prep as PR
from strata.operators import search as K
from strata.plans.catalog import register, table
from strata.session import checkpoint_dir
from strata.sources import readers as RD
from strata.sources import sinks as SK


@register("a_csv_roundtrip", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || ', "Mr. X"' || chr(10) || c_mktsegment ELSE c_name END AS "full.name",
       c_nationkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN 'yes' ELSE 'no' END AS answer, c_acctbal > 5000 AS rich,
       CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment
FROM customer""")
def a_csv_roundtrip(spark, sf_dir):
    """customer written as CSV in the shared folder and read back: quotes, line breaks, dots, yes/no, missing values (A1, A4)."""
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit(', "Mr. X"\n'), "c_mktsegment")).otherwise(F.col("c_name"))
    out = c.select("c_custkey", name.alias("full.name"), "c_nationkey", "c_acctbal",
                   F.when(F.col("c_acctbal") > 0, "yes").otherwise("no").alias("answer"), (F.col("c_acctbal") > 5000).alias("rich"),
                   F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/strata-csv-{uuid.uuid4().hex}"
    SK.write_table(out, path, fmt="csv")
    return RD.read_csv(spark, path)


@register("h_stratified_folds_nulls", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderstatus END AS status FROM orders)
SELECT o_orderkey, status,
       CAST((row_number() OVER (PARTITION BY status ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), CAST(o_orderkey AS VARCHAR)) - 1) % 5 AS INTEGER) AS fold
FROM s""")
def h_stratified_folds_nulls(spark, sf_dir):
    """Stratified folds where every seventh stratum is NULL: no row is lost (H1)."""
    o = table(spark, sf_dir, "orders")
    s = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).alias("status"))
    return CV.assign_folds(s, 5, "status", ["o_orderkey"], 42)


@register("f_onehot_every_category", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS slot, CAST((SELECT count(DISTINCT c_name) FROM customer) AS INTEGER) AS width
FROM customer""")
def f_onehot_every_category(spark, sf_dir):
    """One-hot code of a column with over a thousand values: each has its own slot."""
    c = table(spark, sf_dir, "customer")
    model = PR.fit_preprocessor(c, [], ["c_name"])
    slot, width = PR.hot_slot("features")
    return model.transform(c).select("c_custkey", slot.alias("slot"), width.alias("width"))


@register("k_search_rounds", """
WITH n AS (SELECT count(*) AS rows FROM orders)
SELECT i AS round_num, i BETWEEN 1 AND 4 AS rejected, CASE WHEN i BETWEEN 1 AND 4 THEN FALSE END AS improved, rows AS oof_rows
FROM n, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i)""")
def k_search_rounds(spark, sf_dir):
    """Search over four invalid candidates and a valid one: the invalid ones are rejected and no row leaves the loss (K1, K3-K5)."""
    o = table(spark, sf_dir, "orders")
    df = o.select("o_orderkey", "o_totalprice", F.datediff("o_orderdate", F.lit("1992-01-01")).alias("day"), "o_orderpriority",
                  F.when(F.col("o_totalprice") > 250000, "high").otherwise("low").alias("target"))
    cands = [
        K.Candidate("drops rows", [FE.FrameFunction("f", lambda d: d.where(F.col("o_totalprice") > 200000))]),
        K.Candidate("reads the label", [FE.FrameFunction("f", lambda d: d.withColumn("leak", F.col("label")))]),
        K.Candidate("names the target", [FE.Expr("leak", "target = 'high'")]),
        K.Candidate("fails", [FE.Expr("bad", "raise_error(cast(day AS STRING))")]),
        K.Candidate("valid", [FE.Ratio("price_per_day", "o_totalprice", "day")]),
    ]
    res = K.search_features(df, "target", cands, task_type="classification", key_cols=["o_orderkey"], max_rounds=5, patience=5,
                            models=["Decision Tree"], k=5)
    rejected = F.col("executor_error").isNotNull()
    return res.log.select("round_num", rejected.alias("rejected"), F.when(rejected, F.col("improved")).alias("improved"),
                          F.lit(res.final.oof.count()).alias("oof_rows"))
