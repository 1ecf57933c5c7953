"""A training query gives all its models or an error."""

import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from strata.operators import models as M
from strata.operators import train as T

ONE_MODEL = ["g_adaboost", "g_adaboost_reg", "g_forest", "g_gbt", "g_gbt_reg", "g_lightgbm", "g_lightgbm_reg", "g_logreg", "g_tree", "g_trees_reg",
             "g_xgboost", "g_xgboost_reg"]


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("items"))
    spark.range(60).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"), (F.col("id") % 5).alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        (F.col("id") % 50 + 1.0).alias("l_quantity"), (F.col("id") * 31 % 1000 + 0.5).alias("l_extendedprice"), (F.col("id") % 11 / 100).alias("l_discount"),
        (F.col("id") % 9 / 100).alias("l_tax"), F.when(F.col("id") % 3 == 0, "A").otherwise("R").alias("l_returnflag"),
        F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("l_linestatus")).coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return path


def _fails(error):
    def fail(*args, **kwargs):
        raise error
    return fail


@pytest.mark.parametrize("name", ONE_MODEL)
def test_a_failed_training_is_no_empty_board(spark, items, monkeypatch, name):
    """A model that fails in a query raises; before, the board came without it."""
    from __spark_entry__ import queries

    joint = M.joint_fit
    monkeypatch.setattr(M, "joint_fit", lambda n, task, params=None: joint(n, task, params) and _fails(ValueError("does not fit")))
    monkeypatch.setattr(M, "get_model", _fails(ValueError("does not fit")))
    with pytest.raises(T.TrainingFailed, match="does not fit"):
        queries()[name](spark, items)


@pytest.mark.parametrize("where", ["joint_fit", "get_model", "fold"])
def test_a_lost_job_ends_the_run(spark, items, monkeypatch, where):
    """What says nothing about the model (a lost job or disk) is not counted as a model that failed."""
    df = spark.read.parquet(f"{items}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_tax", (F.col("l_discount") > 0.05).cast("string").alias("target"))
    if where == "joint_fit":
        monkeypatch.setattr(M, "joint_fit", lambda n, task, params=None: _fails(Py4JError("job aborted")))
    elif where == "get_model":
        monkeypatch.setattr(M, "get_model", _fails(OSError("No space left on device")))
    else:
        monkeypatch.setattr(T, "_prepare_fold_shared", _fails(Py4JError("job aborted")))
    with pytest.raises((Py4JError, OSError)):
        T.train(df, "target", "classification", key_cols=["l_orderkey"], models=["Decision Tree"], k=2, refit=False)
