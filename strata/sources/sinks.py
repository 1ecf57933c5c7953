"""Sinks: tables, fitted pipelines, run ids and the JSON result contract."""

from __future__ import annotations

import time
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def make_run_id() -> str:
    """Run id ``YYYYmmdd_HHMMSS_<6 hex>`` (A8); rows carry it as ``run_id``."""
    return f"{time.strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex[:6]}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write a DataFrame (A4, A9, A10); ``partition_by=['run_id']`` isolates runs."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_tables(tables: dict[str, DataFrame], base: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> dict[str, str]:
    """Write a dict of result tables under ``base/<name>``; returns the paths."""
    out = {}
    for name, df in tables.items():
        path = f"{base.rstrip('/')}/{name}"
        write_table(df, path, fmt=fmt, mode=mode)
        out[name] = path
    return out


def save_pipeline(model: PipelineModel, path: str) -> str:
    """Persist a fitted pipeline (A5); load it with :func:`load_pipeline`."""
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _clean_double(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def sanitize_doubles(df: DataFrame) -> DataFrame:
    """NaN / +-Inf -> NULL on every double column so JSON stays valid."""
    return df.select(*[
        _clean_double(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def result_contract(log: DataFrame, output_dir: str | None = None, report_name: str | None = None,
                    model_name: str | None = None) -> DataFrame:
    """One JSON document per run from an experiment log.

    Best round is the lowest ``cv_loss`` among completed rounds (ties go to
    the earlier round); delta is the best score less that of round 0 (0 for a
    run without one), and both losses are given.  ``output_dir`` holds a folder
    per run; the report and the model are named below it, the model only for a
    run with a best round.
    """
    from strata.operators.runlog import best_rounds

    best = best_rounds(log).select(
        "run_id", F.col("round_num").alias("best_round"), F.col("cv_score").alias("best_score"),
        F.col("cv_loss").alias("best_loss"), F.col("shap_top").alias("best_top"),
        F.col("shap_dead").alias("best_dead"))
    first = log.where("round_num = 0").select("run_id", F.col("cv_score").alias("baseline_score"), F.col("cv_loss").alias("baseline_loss"))
    base = log.select("run_id").distinct().join(first, "run_id", "left").withColumn("baseline_score", F.coalesce("baseline_score", F.lit(0.0)))
    folder = F.concat_ws("/", F.lit((output_dir or "").rstrip("/")), "run_id") if output_dir else F.lit(None).cast("string")
    below = lambda name: F.concat_ws("/", folder, F.lit(name)) if output_dir and name else F.lit(None).cast("string")
    rounds = (
        log.where("round_num > 0")
        .groupBy("run_id")
        .agg(F.sort_array(F.collect_list(F.struct(
            F.col("round_num").alias("round"),
            _clean_double(F.round("cv_score", 4)).alias("cv_score"),
            _clean_double(F.round("delta", 4)).alias("delta"),
            F.col("improved"),
            F.coalesce("fe_code", F.lit("")).alias("fe_code"),
            F.slice(F.coalesce("shap_top", F.array().cast("array<string>")), 1, 5).alias("top_features"),
            F.coalesce("executor_error", F.lit("")).alias("executor_error"),
        ))).alias("rounds"))
    )
    doc = (
        base.join(best, "run_id", "left").join(rounds, "run_id", "left")
        .select(
            "run_id",
            F.when((F.coalesce("best_round", F.lit(0)) > 0) | (F.col("baseline_score") > 0),
                   F.lit("complete")).otherwise(F.lit("failed")).alias("status"),
            F.coalesce("best_round", F.lit(0)).alias("best_round"),
            _clean_double(F.round(F.coalesce("best_score", "baseline_score"), 4)).alias("cv_score"),
            _clean_double(F.round("baseline_score", 4)).alias("baseline_score"),
            _clean_double(F.round(F.coalesce("best_score", "baseline_score") - F.col("baseline_score"), 4)).alias("delta"),
            _clean_double(F.round("baseline_loss", 4)).alias("baseline_loss"),
            _clean_double(F.round("best_loss", 4)).alias("best_loss"),
            F.when(F.col("best_round").isNotNull(), below(model_name)).alias("model_path"),
            F.slice(F.coalesce("best_top", F.array().cast("array<string>")), 1, 10).alias("top_features"),
            F.slice(F.coalesce("best_dead", F.array().cast("array<string>")), 1, 10).alias("dead_features"),
            F.coalesce("rounds", F.array()).alias("rounds"),
            below(report_name).alias("report_path"), folder.alias("output_dir"),
        )
    )
    return doc.select("run_id", F.to_json(F.struct(*[c for c in doc.columns if c != "run_id"]))
                      .alias("result_json"))
