"""End-to-end runs: profile + EDA (P3), static training run (P1), feature search.

Each run returns its result tables as DataFrames; :func:`write_run` stores
them under one folder per table, partitioned by ``run_id`` so that many runs
live side by side and stay queryable (A8-A10).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions import types as TY
from strata.operators import eda as E
from strata.operators import profile as P
from strata.operators import runlog as L
from strata.operators import search as K
from strata.operators import train as T
from strata.operators.clean import ColumnCleaner
from strata.sources.sinks import make_run_id, result_contract, save_pipeline, write_table


@dataclass
class RunResult:
    run_id: str
    profile: P.Profile
    tables: dict[str, DataFrame] = field(default_factory=dict)
    train: T.TrainResult | None = None
    log: DataFrame | None = None


def eda_tables(df: DataFrame, target: str, prof: P.Profile) -> dict[str, DataFrame]:
    """The tables behind every chart of the report (section 2.D)."""
    nums = [c for c in TY.numeric_columns(df) if c != target]
    tables = {
        "target_chart": E.target_bars(df, target, prof.task_type),
        "missing": E.missing_table(prof.columns),
        "feature_histograms": E.feature_histograms(df, target),
        "correlation": E.correlation_matrix(df, nums),
        "shape": E.shape_summary(df),
        "column_summary": E.column_summary(df, target),
        "most_skewed": E.most_skewed(prof.columns),
    }
    if TY.is_real_numeric(df.schema[target].dataType):
        tables["target_correlation"] = E.target_correlation(df, target)
    if prof.task_type == "classification":
        tables["target_balance"] = E.target_balance(df, target)
    else:
        tables["target_range"] = E.target_range(df, target)
    return tables


def profile_and_eda(df: DataFrame, target: str, run_id: str | None = None) -> RunResult:
    """Profile document plus EDA tables."""
    prof = P.profile(df, target)
    tables = {"column_profile": prof.columns, "target_profile": prof.target_stats,
              "task_votes": prof.votes, "warnings": prof.warnings, **eda_tables(df, target, prof)}
    return RunResult(run_id or make_run_id(), prof, tables)


def _cleaning_table(df: DataFrame, target: str, key_cols) -> DataFrame:
    return ColumnCleaner(excludeCols=[target, *(key_cols or [])]).report(df)


def static_run(df: DataFrame, target: str, key_cols: list[str] | None = None, models: list[str] | None = None,
               k: int = 5, model_params: dict | None = None, run_id: str | None = None) -> RunResult:
    """Profile, clean, cross-validate the model list, refit the best."""
    run = profile_and_eda(df, target, run_id)
    res = T.train(df, target, run.profile.task_type, key_cols=key_cols, models=models, k=k,
                  model_params=model_params)
    top, dead = K._lists(res)
    spark = df.sparkSession
    log = spark.createDataFrame(
        [(run.run_id, 0, None, K._f(res.cv_score), K._f(res.cv_loss), None, False, res.status, None,
          top, dead, res.best_model_name, [])], K.LOG_SCHEMA)
    run.train, run.log = res, log
    run.tables.update(_report_tables(log))
    run.tables["cleaning"] = _cleaning_table(df, target, key_cols)
    if res.leaderboard is not None:
        run.tables["leaderboard"] = res.leaderboard
    return run


def search_run(df: DataFrame, target: str, candidates: list[K.Candidate] | None = None,
               key_cols: list[str] | None = None, run_id: str | None = None, **kwargs) -> RunResult:
    """Profile, baseline, feature search over candidates, final model."""
    run = profile_and_eda(df, target, run_id)
    cands = candidates if candidates is not None else K.auto_candidates(
        df, target, exclude=list(key_cols or []))
    sr = K.search_features(df, target, cands, run_id=run.run_id, task_type=run.profile.task_type,
                           key_cols=key_cols, **kwargs)
    run.train, run.log = sr.final, sr.log
    run.tables.update(_report_tables(sr.log))
    if sr.final is not None and sr.final.leaderboard is not None:
        run.tables["leaderboard"] = sr.final.leaderboard
    return run


def _report_tables(log: DataFrame) -> dict[str, DataFrame]:
    """Report sections as tables (section 2.L, A10)."""
    return {"experiment_log": log, "progression": L.progression(log), "summary": L.summary(log),
            "recommendation": L.recommendation(log), "best_features": L.best_features(log),
            "round_details": L.round_details(log), "result": result_contract(log)}


def write_run(run: RunResult, base: str, fmt: str = "parquet", save_model: bool = True) -> dict[str, str]:
    """Write every table with a ``run_id`` column, partitioned by it (A8-A10), and the model (A5)."""
    paths = {}
    for name, df in run.tables.items():
        out = df if "run_id" in df.columns else df.withColumn("run_id", F.lit(run.run_id))
        path = f"{base.rstrip('/')}/{name}"
        write_table(out, path, fmt=fmt, mode="append", partition_by=["run_id"])
        paths[name] = path
    if save_model and run.train is not None and run.train.pipeline is not None:
        paths["model"] = save_pipeline(run.train.pipeline, f"{base.rstrip('/')}/models/{run.run_id}")
    return paths
