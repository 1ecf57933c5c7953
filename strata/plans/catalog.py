"""Registered queries over the supplied tables, each with its DuckDB oracle.

Every query reads whole tables from ``sf_dir`` and runs one library
operator (or a small composition) on them.  Where a table lacks nulls, IDs or
constants, nulls are injected by a fixed rule applied identically in the
oracle SQL.  The oracle text states the same semantics in plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.readers import canonical_nulls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table with NaN canonicalised to NULL."""
    return canonical_nulls(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _load_all():
    # importing the modules fills QUERIES / ORACLE
    from strata.plans import q_profile, q_eda, q_clean_prep, q_cv, q_features, q_runlog, q_models, q_rules  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
