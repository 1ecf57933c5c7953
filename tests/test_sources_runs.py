"""Readers, sinks and end-to-end runs."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from strata.plans import runs as RUNS
from strata.sources import readers as RD
from strata.sources import sinks as SK


def test_csv_na_tokens_and_type_inference(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("age,fare,name,flag,target\n22,7.25,A,true,0\nNA,71.3,,false,1\n38,N/A,C,true,1\n")
    df = RD.read_csv(spark, str(p))
    types = dict(df.dtypes)
    assert types == {"age": "bigint", "fare": "double", "name": "string", "flag": "boolean", "target": "bigint"}
    rows = df.orderBy("target", "age").collect()
    assert sum(r["age"] is None for r in rows) == 1 and sum(r["name"] is None for r in rows) == 1


def test_canonical_nulls_and_inf(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "x double")
    assert RD.canonical_nulls(df).where("x IS NULL").count() == 1
    assert RD.inf_to_null(df).where("x IS NULL").count() == 2


def test_require_column(spark):
    with pytest.raises(ValueError, match="Available columns: a"):
        RD.require_column(spark.createDataFrame([(1,)], "a int"), "t")


def test_run_id_format():
    rid = SK.make_run_id()
    assert len(rid) == 22 and rid[8] == "_" and rid[15] == "_"


def test_static_run_writes_tables_and_contract(spark):
    rows = [(i, float(i % 7), "a" if i % 3 else "b", "yes" if (i % 7) > 3 else "no") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, x double, c string, target string")
    run = RUNS.static_run(df, "target", key_cols=["id"], models=["Decision Tree"], k=3)
    doc = json.loads(run.tables["result"].first()["result_json"])
    assert doc["status"] == "complete" and doc["best_round"] == 0 and doc["cv_score"] > 0.9
    out = tempfile.mkdtemp(prefix="strata-test-")
    paths = RUNS.write_run(run, out)
    back = spark.read.parquet(paths["leaderboard"])
    assert back.where(F.col("run_id") == run.run_id).count() == 1
    assert os.path.isdir(paths["model"])
    model = SK.load_pipeline(paths["model"])
    assert model.transform(df).count() == 90
